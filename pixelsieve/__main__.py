import sys

from pixelsieve.cli import main

sys.exit(main())

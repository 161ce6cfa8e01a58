import numpy as np
import pytest

from pixelsieve.functions import kernel
from pixelsieve.functions.synthetic import checkerboard, gradient, uniform

# Published fingerprints of two synthetic images.
GRADIENT_64X48 = "13424242421341e1e3e3e24141e2e3e3e14141e2e3e3e24140e1e3e3e141134242424213000000000000000000000000000000000000000000000000000000000000000000000000113a3a3a3a113ccdcdcdcd3c3ccfcfcfcf3c3dcfcfcfcf3c3ccdcdcdcd3c113a3a3a3a11000000000000000000000000000000000000000000000000000000000000000000000000"
CHECKERBOARD_32 = "0860161660080fbd7272bd0f0324b2b2240316ff5555ff16096f91916f0900003c3c000000003c3c0000096f91916f0916ff5555ff160324b2b224030fbd7272bd0f086016166008080f0316090060bd24ff6f001672b255913c1672b255913c60bd24ff6f00080f03160900000916030f08006fff24bd603c9155b272163c9155b27216006fff24bd60000916030f08"


def test_golden():
    assert kernel.fingerprint(gradient(64, 48)).hex() == GRADIENT_64X48
    assert kernel.fingerprint(checkerboard(32, 32)).hex() == CHECKERBOARD_32


@pytest.mark.parametrize("rgb", [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (127, 127, 127), (10, 20, 30), (1, 1, 2)])
def test_uniform_is_zero(rgb):
    for size in (1, 16, 32):
        assert kernel.fingerprint(uniform(size, size, rgb)) == kernel.ZERO


def test_edges():
    assert kernel.fingerprint(np.zeros((0, 0, 3), np.uint8)) == kernel.ZERO
    assert kernel.fingerprint(gradient(64, 48), version=2) == kernel.ZERO
    assert kernel.fingerprint(gradient(640, 32)) != kernel.ZERO
    raw = gradient(64, 48).tobytes()
    assert kernel.from_rgb(64, 48, raw + b"more").hex() == GRADIENT_64X48
    assert kernel.from_rgb(64, 48, raw[:-1]) == kernel.from_rgb(0, 5, raw) == kernel.ZERO
    assert len({kernel.fingerprint(gradient(160, 120)) for _ in range(32)}) == 1


def test_changes_move_little():
    image = gradient(160, 120)
    at = lambda x: np.frombuffer(kernel.fingerprint(x), np.uint8).astype(int)
    far = lambda x: float(np.sqrt(((at(x) - at(image)) ** 2).sum()))
    assert 0 < far(np.clip(image.astype(int) + 12, 0, 255).astype(np.uint8)) < 50
    assert 0 < far(np.clip(image * 1.08, 0, 255).astype(np.uint8)) < 50
    moved = np.pad(image, ((1, 0), (2, 0), (0, 0)), "edge")[:120, :160]
    assert 0 < far(moved) < 80

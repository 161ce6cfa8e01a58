"""Image moderation analytics on Spark: perceptual fingerprints, near-duplicate search, decisions."""

__version__ = "0.1.0"

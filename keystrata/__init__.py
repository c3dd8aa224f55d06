"""Key-value log analytics on Spark: an append-only mutation log and the state folded from it."""

__version__ = "0.1.0"

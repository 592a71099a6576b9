"""Time-versioned ("type-2") data on Spark: history, deltas, intervals and change feeds."""

__version__ = "0.1.0"

"""tidemark: event analytics on Spark with one safe watermark between history and fresh data."""

__version__ = "0.1.0"

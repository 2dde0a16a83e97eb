"""trellis — code-corpus analytics on Spark (DataFrame, SQL and Structured Streaming)."""

__version__ = "0.1.0"

"""tideloom: event clustering and analytics over social posts, written for Spark DataFrames."""

__version__ = "0.1.0"

"""quoin: architecture-quality analytics over source trees, as Spark DataFrames."""

__version__ = "0.1.0"

"""Event intelligence on Spark: ingestion, merging, scoring and ranking of news-like events as DataFrame plans."""

__version__ = "0.1.0"

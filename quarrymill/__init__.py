"""quarrymill: Spark-first building, auditing and scoring of text and code corpora."""

__version__ = "0.1.0"

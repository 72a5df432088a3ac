"""lodestat: quality analytics over large tables, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

"""vanthu: a Spark engine for searching, linking and preparing administrative documents."""

__version__ = "0.1.0"

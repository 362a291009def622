"""millrace: declarative dataset pipelines and wiki-dump analytics on PySpark DataFrames."""

__version__ = "0.1.0"

"""spanloom: text-span, terminology and corpus analytics expressed on PySpark DataFrames."""

__version__ = "0.1.0"

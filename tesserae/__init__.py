"""Analytics over corpora of source code and text, on PySpark DataFrames."""

__version__ = "0.1.0"

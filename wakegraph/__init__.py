"""wakegraph: change-impact analytics on labelled property graphs held as Spark DataFrames."""

__version__ = "0.1.0"

"""Document analytics on Spark: documents, pages, blocks, lines, cells and figures as DataFrames."""

__version__ = "0.1.0"

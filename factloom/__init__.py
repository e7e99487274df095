"""factloom: facts, chunks and evidence retrieval as Spark DataFrames."""

__version__ = "0.1.0"

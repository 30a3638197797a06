"""taskloom: dataflow analytics over task and access logs, on Spark DataFrames."""

__version__ = "0.1.0"

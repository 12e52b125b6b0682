"""gnomon: a time-series analytics engine on PySpark DataFrames."""

"""Vector-symbolic analytics on Spark DataFrames."""

"""Column-level lineage and impact analytics on Spark DataFrames."""

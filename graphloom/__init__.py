"""Code-graph and entity-graph analytics on Spark DataFrames."""

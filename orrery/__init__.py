"""orrery: N-body simulation analytics on Spark DataFrames."""

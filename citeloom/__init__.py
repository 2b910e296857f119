"""Literature-graph analytics on PySpark DataFrames."""

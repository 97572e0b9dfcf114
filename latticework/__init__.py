"""Property-graph analytics over source code and relational tables, on Spark DataFrames."""

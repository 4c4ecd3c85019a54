"""graphloom: graph analytics over Spark DataFrames."""

"""vectrail: typed property graphs and vector search as Spark DataFrames."""

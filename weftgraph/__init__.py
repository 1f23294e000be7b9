"""Graph analytics on Spark: pattern queries, traversal, search and derivation over
nodes and edges held as DataFrames."""

"""Statistical operators. All take nodes (id, ...) and weights (focal, neighbor, weight)
as DataFrames and return DataFrames; global ones have one row, local ones a row a node."""

"""Table-to-table jobs; each takes DataFrames and returns a DataFrame."""

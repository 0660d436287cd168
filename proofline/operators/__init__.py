"""Rules, issue algebra and serving queries, each a function from DataFrames to a DataFrame."""

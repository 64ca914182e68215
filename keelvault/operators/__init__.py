"""Entity operators: each takes DataFrames and returns, lazily, the rows to insert."""

"""DataFrame operators: every function takes DataFrames and returns DataFrames
(fits return small parameter objects)."""

"""The monthly jobs, put together from operators, sources and functions."""

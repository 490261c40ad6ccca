"""The operators that also run on unbounded input."""

"""Column functions: dates, cleaning, encoding and text formatting."""

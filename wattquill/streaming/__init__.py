"""The row-wise and windowed operators on unbounded input."""

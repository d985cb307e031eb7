"""Column functions and small Arrow helpers."""

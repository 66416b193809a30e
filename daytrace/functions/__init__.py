"""Column functions and the fixed dictionaries that they use."""

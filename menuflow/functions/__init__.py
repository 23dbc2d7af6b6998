"""Column functions: text, numbers, dates, collections."""

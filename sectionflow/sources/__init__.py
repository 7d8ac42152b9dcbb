"""Reading and writing section tables."""

"""Training-data operators: quality, language, duplicates, leaks, packing, formats."""

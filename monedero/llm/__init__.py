"""Training-data operators: language, quality, duplicates, leaks, secrets, mixing, search and archives."""

"""Matrix Market text, graphs from tables, generated graphs."""

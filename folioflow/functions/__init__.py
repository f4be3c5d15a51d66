"""Column functions: expressions that stay inside one row."""

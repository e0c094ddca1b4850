"""DataFrame operators, grouped by family."""

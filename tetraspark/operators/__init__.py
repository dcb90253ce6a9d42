"""Terms, quad datasets, updates and the compatibility engine."""

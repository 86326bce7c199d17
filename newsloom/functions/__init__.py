"""Column functions: no joins and no shuffles, safe inside any projection."""

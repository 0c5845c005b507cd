"""Column functions: signatures, token windows, vectors."""

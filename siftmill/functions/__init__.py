"""Column functions on texts, paths and files."""

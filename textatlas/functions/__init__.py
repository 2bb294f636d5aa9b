"""Column functions: text, metadata, colours."""

"""Column functions: text, mathematics, prediction parsing, chunking."""

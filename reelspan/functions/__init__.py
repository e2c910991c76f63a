"""Column functions: clock strings, text, paths, similarity."""

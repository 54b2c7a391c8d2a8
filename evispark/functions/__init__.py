"""Column builders: text, URLs and ordered rules."""

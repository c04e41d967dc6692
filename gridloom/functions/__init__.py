"""Column expressions: parsing of text, comparison and arithmetic."""

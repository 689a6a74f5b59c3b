"""Column functions: text, identifiers, translation and score bands."""

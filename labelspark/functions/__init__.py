"""Column expressions: text, hashing and score arithmetic."""

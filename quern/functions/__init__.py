"""Column functions: cleaning, parsing and scoring expressions."""

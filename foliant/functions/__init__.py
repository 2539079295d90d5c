"""Column functions for text, vectors and personal data."""

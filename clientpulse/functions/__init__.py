"""Column helpers: dates, vectors, text and scalar expressions."""

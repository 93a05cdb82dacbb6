"""Column functions: vectors, text, lemmas."""

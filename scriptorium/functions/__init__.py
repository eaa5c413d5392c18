"""Column functions: text, numbers in words, identities, signals, metrics, loudness."""

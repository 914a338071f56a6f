"""Column expressions: text cleaning, words, token arrays, logits."""

"""Column functions: text folding, tokens, similarities, set features."""

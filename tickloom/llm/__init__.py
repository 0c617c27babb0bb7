"""Operators for training data: similar vectors, tokenizer encoding, source mixing, content scores."""

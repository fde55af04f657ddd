"""Operators that prepare a text corpus for training.  Nothing else in tessera imports this."""

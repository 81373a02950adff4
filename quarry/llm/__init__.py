"""Operators that prepare text for language-model training; nothing else in quarry imports this package."""

"""Operators for preparing language-model training text; nothing else in flowtally imports this package."""

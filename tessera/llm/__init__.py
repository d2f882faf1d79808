"""Operators on text for language-model training data; nothing outside this folder imports it."""

"""Operators for preparing large text, page, chat and vector collections as training data."""

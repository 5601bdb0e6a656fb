"""Operators for preparing training data: chat formatting, near-duplicate and vector search, mixing,
filtering, extraction, tokenising and scoring.  Nothing else in the library imports this subpackage."""

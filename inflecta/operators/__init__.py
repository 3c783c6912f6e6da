"""Operators over DataFrames: lexicon generation and look-up, language routing, indexing, search and scores."""

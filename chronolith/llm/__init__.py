"""Operators for the texts and identifiers of language-model corpora."""

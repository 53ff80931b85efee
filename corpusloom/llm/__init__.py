"""Operators for preparing training corpora: each module holds one operator and the query that applies it."""

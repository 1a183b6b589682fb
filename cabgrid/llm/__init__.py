"""Operators of a training-data pipeline (documents, benchmark, conversations)."""

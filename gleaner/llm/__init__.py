"""Operators for training-data corpora (documents, embeddings). Nothing outside this subpackage imports it."""

"""Readers of documents, and the messages in which documents arrive."""

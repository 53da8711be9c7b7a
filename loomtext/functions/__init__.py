"""Scalar functions: tokens, normal forms, URLs, display."""

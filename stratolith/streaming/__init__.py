"""Stratolith streaming."""

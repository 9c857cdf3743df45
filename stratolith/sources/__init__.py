"""Stratolith sources."""

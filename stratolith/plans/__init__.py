"""Stratolith plans."""

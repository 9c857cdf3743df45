"""Stratolith functions."""

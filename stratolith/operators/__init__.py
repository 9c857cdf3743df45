"""Stratolith operators."""

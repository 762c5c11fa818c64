"""Paths, fonts and scan conversion."""

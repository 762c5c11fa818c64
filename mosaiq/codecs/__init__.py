"""Decoders from file bytes to pixels. Each is a function of bytes; Spark runs them a file a row."""

"""Readers, snapshot flattening, item lists and result writers."""

"""Streams. The reference set of operators has none as tables; these are extensions."""

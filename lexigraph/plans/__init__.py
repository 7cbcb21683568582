"""Composed searches, and the registered queries."""

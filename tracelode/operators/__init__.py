"""Logical operators over the tables of a code graph."""

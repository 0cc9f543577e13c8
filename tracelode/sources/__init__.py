"""Readers and writers of entry streams, unit archives and indexes."""

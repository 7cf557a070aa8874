"""Readers, writers, the fact schema and the test fixture views."""

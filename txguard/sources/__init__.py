"""Readers, writers and the transaction view."""

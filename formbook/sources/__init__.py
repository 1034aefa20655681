"""Readers, writers and the adapter views."""

"""Readers, writers and the canonical retail views."""

"""Readers and writers of recordings, windows, features and result tables."""

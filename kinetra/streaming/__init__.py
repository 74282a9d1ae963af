"""Sliding windows over unbounded signals with Structured Streaming (an extension)."""

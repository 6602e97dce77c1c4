"""Streaming over landing folders (an extension)."""

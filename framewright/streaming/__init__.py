"""Structured Streaming over frames (an extension: batch and stream share one plan)."""

"""Structured Streaming jobs: change detection, continuous apply, new change files."""

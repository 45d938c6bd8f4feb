"""Structured Streaming jobs: landing, fresh tier, rollups, keyed state."""

"""Structured Streaming counterparts: windows with watermarks and stateful sketches."""

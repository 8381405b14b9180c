"""Landed payloads -> ``raw_posts`` rows, and the merge / publish sinks."""

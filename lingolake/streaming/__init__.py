"""streaming of the transcript library."""

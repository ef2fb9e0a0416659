"""sources of the transcript library."""

"""operators of the transcript library."""

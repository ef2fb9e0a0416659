"""functions of the transcript library."""

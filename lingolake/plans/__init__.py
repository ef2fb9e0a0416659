"""plans of the transcript library."""

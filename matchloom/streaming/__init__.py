"""streaming of the match analytics library."""

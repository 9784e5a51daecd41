"""sources of the match analytics library."""

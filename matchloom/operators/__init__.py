"""operators of the match analytics library."""

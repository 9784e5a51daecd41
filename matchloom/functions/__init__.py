"""functions of the match analytics library."""

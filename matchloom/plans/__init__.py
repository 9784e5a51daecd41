"""plans of the match analytics library."""

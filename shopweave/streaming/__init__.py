"""streaming of the shop analytics library."""

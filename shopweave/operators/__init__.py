"""operators of the shop analytics library."""

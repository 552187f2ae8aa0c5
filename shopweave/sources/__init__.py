"""sources of the shop analytics library."""

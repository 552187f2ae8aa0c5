"""functions of the shop analytics library."""

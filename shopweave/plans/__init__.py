"""plans of the shop analytics library."""

"""Models of the library."""

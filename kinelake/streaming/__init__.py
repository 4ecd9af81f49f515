"""Episodes as streams."""

"""Sessions as streams."""

"""nichespark streaming."""

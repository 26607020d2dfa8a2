"""nichespark plans."""

"""nichespark sources."""

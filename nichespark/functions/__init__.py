"""nichespark functions."""

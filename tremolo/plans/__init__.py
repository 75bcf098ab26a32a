"""Input frames and whole flows."""

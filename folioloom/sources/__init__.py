"""Where books come from."""

"""streaming of shelfspark."""

"""operators of shelfspark."""

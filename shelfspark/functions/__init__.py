"""functions of shelfspark."""

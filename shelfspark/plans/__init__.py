"""plans of shelfspark."""

"""shelfspark: product search, ranking and corpus analytics on PySpark."""

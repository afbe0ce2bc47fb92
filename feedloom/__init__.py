"""Feed-corpus analytics and retrieval on PySpark."""

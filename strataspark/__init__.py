"""Entity knowledge base and vector analytics on Spark."""

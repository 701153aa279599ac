"""docloom: document-knowledge analytics expressed as Spark DataFrame jobs."""

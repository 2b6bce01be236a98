"""Document-to-knowledge engine expressed as Spark DataFrame plans."""

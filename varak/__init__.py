"""Text-mining engine expressed as Spark DataFrame transformations."""

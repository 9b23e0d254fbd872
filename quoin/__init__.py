"""quoin: span-annotated text analytics expressed as Spark DataFrame plans."""

"""barloom: bar-series analytics expressed as Spark DataFrame plans."""

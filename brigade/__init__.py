"""Recipe extraction, normalisation and search as Spark DataFrame transformations."""

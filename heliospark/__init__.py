"""Sun-and-shade analytics for walks, as Spark DataFrame pipelines."""

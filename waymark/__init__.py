"""waymark: record linkage and geospatial resolution as Spark DataFrame jobs."""

"""melder: record resolution, fusion and corpus preparation as lazy PySpark plans."""

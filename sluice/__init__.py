"""Filter-circuit analytics on PySpark."""

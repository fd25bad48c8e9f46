"""Panel analytics on PySpark: many short monthly series, one DataFrame at a time."""

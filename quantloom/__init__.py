"""Panel research operators as PySpark DataFrame functions."""

"""Event processing and transaction risk analytics as PySpark DataFrame plans."""

"""Section-store analytics on PySpark: relations, functions, layouts and sinks for note archives."""

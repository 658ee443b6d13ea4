"""tideway: freight-network analytics on PySpark."""

"""A federated analytics engine on PySpark."""

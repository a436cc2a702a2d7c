"""tidelog: key-value state, mutation logs and replicated-log analytics on PySpark."""

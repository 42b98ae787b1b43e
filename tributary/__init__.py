"""Multi-dialect SQL analytics on PySpark."""

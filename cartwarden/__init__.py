"""Commerce-event and fraud analytics on PySpark."""

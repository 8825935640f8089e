"""folioscan: document monitoring, entity linking, change tracking and hybrid retrieval on PySpark."""

"""A Spark engine that judges print jobs, matches templates and tracks orders."""

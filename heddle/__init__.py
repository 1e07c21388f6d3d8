"""heddle: a role-aware relational query engine expressed as Spark plans."""

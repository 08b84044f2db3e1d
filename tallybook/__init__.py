"""Document reconciliation analytics on Spark: column functions, operators, sources, plans and streams."""

"""Ready plans: graphs from tables, one query for each operator, and their SQL."""

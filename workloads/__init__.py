"""Driver workloads: ledgers derived from the given tables, queries and their SQL."""

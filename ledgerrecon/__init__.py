"""Reconcile two ledgers at scale with plain Spark DataFrames."""

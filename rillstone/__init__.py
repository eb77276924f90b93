"""Rillstone: identity reconciliation and query operators as Spark DataFrame plans."""

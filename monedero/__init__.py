"""Spending-ledger analytics as Spark DataFrame operators."""

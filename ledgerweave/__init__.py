"""Ledger and corpus analytics as Spark DataFrame operators."""

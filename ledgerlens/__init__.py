"""Spend-audit analytics expressed as Spark DataFrame programs."""

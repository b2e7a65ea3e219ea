"""Quantity take-off from drawing entities as PySpark DataFrame operators."""

"""Spatial usage analytics expressed as PySpark DataFrame plans."""

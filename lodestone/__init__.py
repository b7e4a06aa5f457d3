"""Lodestone: repository analytics as Spark DataFrame plans."""

"""Grounded retrieval and corpus analytics as Spark DataFrame transformations."""

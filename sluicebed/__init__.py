"""Sluicebed: dataset curation and evaluation analytics as lazy Spark DataFrame operators."""

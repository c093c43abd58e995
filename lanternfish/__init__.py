"""Lanternfish: hybrid retrieval and corpus analytics on PySpark."""

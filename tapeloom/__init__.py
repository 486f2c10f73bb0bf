"""Spark-first analytics over large catalogues of semi-structured recordings metadata."""

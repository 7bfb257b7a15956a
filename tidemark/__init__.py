"""Spark-first analytics over ordered frame series and the sessions around them."""

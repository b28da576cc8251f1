"""Recursive rule queries on Spark: programs of typed relations and rules, compiled to DataFrame plans."""

"""Scalar expressions of the rule language."""

"""Checks, literal order, and rewrites of programs; everything here runs on the driver, over rules alone."""

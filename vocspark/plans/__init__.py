"""Whole jobs: the layered pipeline, the registered queries and their SQL twins."""

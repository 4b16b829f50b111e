"""Encounter analytics on Spark: operators, sources and the query catalog."""

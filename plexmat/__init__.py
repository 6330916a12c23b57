"""Integration of several entity-by-feature matrices on Spark."""

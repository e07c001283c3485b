"""Mutation-log analytics on Spark."""

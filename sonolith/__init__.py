"""Similarity analytics over bit fingerprints on Spark."""

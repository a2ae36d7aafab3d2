"""Dyad-persistence analytics over timestamped interactions, as Spark plans."""

"""Tidy verbs, statistics and formula models as lazy Spark plans."""

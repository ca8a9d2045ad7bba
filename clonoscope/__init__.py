"""Labelled bags of sequences on Spark: counts, enrichment tests, diversity, ranking, graphs."""

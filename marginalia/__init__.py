"""Marginalia: DataFrame operators for mining and curating text-derived records on Spark."""

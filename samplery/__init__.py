"""Sampling, annotation and dataset operators for labelled record collections on Spark."""

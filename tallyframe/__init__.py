"""Audit labelled data sets and evaluate binary classifiers as Spark jobs."""

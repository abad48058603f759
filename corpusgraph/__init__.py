"""Corpus-to-knowledge-graph jobs as table-in, table-out Spark DataFrame functions."""

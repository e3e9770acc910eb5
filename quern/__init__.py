"""Spark-first passage retrieval, context selection and answer scoring."""

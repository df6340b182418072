"""Foliant: document analytics and retrieval as composable Spark DataFrame operators."""

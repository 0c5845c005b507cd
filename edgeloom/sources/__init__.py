"""Readers and writers of edge tables, configurations, vectors and results."""

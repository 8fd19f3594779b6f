"""Clustering algorithms; each returns a labeling ``(row_id, cluster)`` with -1 = noise."""

"""Plans: derived fixtures, the end-to-end workflow and the query catalog."""

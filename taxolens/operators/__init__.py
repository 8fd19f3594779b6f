"""DataFrame operators: metrics, reports, vectors, neighbours, clustering, ensembles."""

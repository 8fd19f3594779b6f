"""Sources and sinks: parquet tables, product JSON, sampling, caches, payload scans."""

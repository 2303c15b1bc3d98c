"""docrecon: trade-document jobs on Spark tables (see README.md)."""

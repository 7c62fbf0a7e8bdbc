"""PySpark jobs over media catalogues: ingestion, reconciliation, fuzzy search, evaluation and logs."""

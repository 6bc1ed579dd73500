"""End-to-end jobs: fixtures, MLlib k-fold runners and the query catalogue."""

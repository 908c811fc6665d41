"""Table schemas, readers, writers, seed rows and test projections."""

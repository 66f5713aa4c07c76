"""Table definitions, readers, writers and the test-data mapping."""

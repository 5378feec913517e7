"""Registry of named queries over the test tables."""

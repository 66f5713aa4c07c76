"""Registry of named queries and their independent SQL statements."""

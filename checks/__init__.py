"""Queries over the supplied tables, in Spark and in SQL, that check the library."""

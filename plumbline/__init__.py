"""Data contract checks, catalog comparison and conforming of tables on Spark."""

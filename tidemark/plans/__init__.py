"""Runnable queries over the stored tables, each with the SQL it must agree with."""

"""Readers and the derivations that turn stored tables into event streams."""

"""Registered queries (one per operator key) and the flagship plan."""

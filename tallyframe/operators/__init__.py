"""Ledger operators, each ``DataFrame -> DataFrame``: reports, listings, matching, extraction,
bulk commands, advice, notification and the pluggable model hooks."""

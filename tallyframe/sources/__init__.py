"""Inputs and outputs: driver-table readers, raw-mail scans and logs, idempotent loads, sinks."""

"""Watchloom: host-security telemetry analytics expressed as Spark DataFrame plans."""

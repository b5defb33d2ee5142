"""Public-transport telemetry analytics as Spark plans."""

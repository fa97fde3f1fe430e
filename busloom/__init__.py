"""Bus-telemetry analytics and corpus operators as Spark DataFrame programs."""

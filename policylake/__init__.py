"""policylake: cellular telemetry and offline policy evaluation as Spark DataFrame jobs."""

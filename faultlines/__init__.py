"""faultlines: build-log diagnostics analytics as Spark DataFrame jobs."""

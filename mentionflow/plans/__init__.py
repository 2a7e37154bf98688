"""Query plans: the registered query catalogue, reports and batch jobs."""

"""casewright: case and statute analytics as plain Spark DataFrame jobs."""

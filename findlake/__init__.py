"""findlake: security-findings analytics and reconciliation as Spark DataFrame operators."""

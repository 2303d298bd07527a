"""Layout analytics and report reconciliation as Spark DataFrame operators."""

"""Job-market analytics as composable Spark DataFrame operators."""

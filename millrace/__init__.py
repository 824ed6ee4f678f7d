"""millrace: a Spark-first analytics and machine-learning engine."""

"""A Spark-first question-answering and text-ranking analytics engine."""

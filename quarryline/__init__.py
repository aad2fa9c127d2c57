"""Text-corpus, retrieval and training-data jobs on Spark."""

"""Batch jobs over structured documents on Spark: chunking, retrieval, graph building and checks, evaluation."""

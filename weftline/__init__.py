"""Graph-augmented document retrieval as Spark jobs: ingest, merge, search, context assembly and a task queue."""

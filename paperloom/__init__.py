"""Literature records to a queryable graph, as Spark jobs."""

"""Evidence analytics over document collections, written as Spark jobs."""

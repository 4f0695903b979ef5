"""shardwell: chunk, graph, search and view analytics as Spark DataFrame plans."""

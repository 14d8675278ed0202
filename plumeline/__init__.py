"""Registry and feed documents in, canonical articles, summaries, views and a search index out, on Spark."""

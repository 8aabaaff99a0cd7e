"""Corpus, retrieval and crawl analytics as Spark jobs."""

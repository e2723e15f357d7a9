"""docmill: retrieval analytics over large document corpora, as Spark jobs."""

"""quern: knowledge-retrieval analytics as declarative Spark plans."""

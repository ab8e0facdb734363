"""copycensus: redundancy audits of labelled corpora as Spark jobs."""

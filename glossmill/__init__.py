"""glossmill: lexical annotation and text pipelines as Spark jobs."""

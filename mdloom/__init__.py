"""mdloom: a corpus of documents in, clean Markdown out, as Spark jobs."""

"""docketlake: analytics over a corpus of legal documents, written as Spark jobs."""

"""Evidence analytics over meeting-document corpora, as DataFrame-in / DataFrame-out Spark jobs."""

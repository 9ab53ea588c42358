"""contactline: contact enrichment of organisation tables as Spark jobs."""

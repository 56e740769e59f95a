"""tidemark: ordered-market-data analytics and corpus operators as Spark DataFrame jobs."""

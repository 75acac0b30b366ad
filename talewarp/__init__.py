"""talewarp: transcript analytics, hybrid retrieval and corpus preparation on Spark."""

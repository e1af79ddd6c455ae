"""terncove: lead analytics and corpus preparation expressed as Spark plans."""

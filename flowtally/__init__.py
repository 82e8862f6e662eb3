"""Part of flowtally, analytics of fixed-interval sensor counts on Spark."""

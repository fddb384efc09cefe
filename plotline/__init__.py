"""Property-market intelligence jobs on Spark."""

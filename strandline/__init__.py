"""Analytics of conversations and documents on Spark."""

"""Rule mining on Spark."""

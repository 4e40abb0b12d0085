"""Analytics of AI coding agents' activity logs as Spark plans."""

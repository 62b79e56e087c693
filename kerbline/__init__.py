"""Located, time-stamped violation events turned into dispatch decisions, on Spark."""

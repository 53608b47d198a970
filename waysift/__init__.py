"""Trace analytics on Spark: event DAGs, critical paths, latency groups, path catalogue, tracepoint search."""

"""Plan assembly: aggregate batching, the full report, its registered queries and SQL."""

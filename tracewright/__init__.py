"""Build-trace and dependency-graph analytics on Spark."""

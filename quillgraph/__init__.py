"""Link-graph-aware document analytics on Spark."""

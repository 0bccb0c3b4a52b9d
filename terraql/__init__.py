"""An analytics engine of DataFrame operators and SQL semantics for record-oriented queries on Spark."""

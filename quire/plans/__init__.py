"""Named query catalogue (Spark side) and its DuckDB oracle SQL."""

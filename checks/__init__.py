"""DuckDB statements that compute every report a second time, independently of Spark."""

"""Sources: parquet tables, landed pages, JSON record stores."""

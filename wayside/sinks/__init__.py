"""Writers: partitioned files, bucketed tables, databases."""

"""Sources: warehouse parquet scans, derived claim/tenant tables, raw CSV,
seed CSV, report JSON, JDBC, and the deterministic synthetic generator."""

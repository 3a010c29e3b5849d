"""Column functions and small helpers: retry jitter, little-endian counters, cron expressions."""

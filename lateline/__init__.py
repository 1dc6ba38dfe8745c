"""Transit-delay analytics on Spark: schedule, real-time, rollups, features, audits."""

"""Reading and writing of episode logs, statistics, ranges and records."""

"""Support-knowledge analytics as DataFrame and SQL jobs."""

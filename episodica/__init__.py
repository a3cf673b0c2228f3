"""Episode-log analytics on Spark: replay, grading, rewards and domain tables."""

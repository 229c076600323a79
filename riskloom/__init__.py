"""Change-risk analytics on Spark: extraction, matching, scoring, history and streams."""

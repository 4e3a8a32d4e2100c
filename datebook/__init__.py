"""Spark jobs that turn web text into calendar records and measure how well that went."""

"""Which orders get a bad review, and why: Spark operators over order, item and review tables."""

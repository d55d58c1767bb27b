"""Customer-event analytics on Spark: features, labels, selection, scoring, metrics and recommendations."""

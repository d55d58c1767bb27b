"""Table, artifact and test-table sources and sinks."""

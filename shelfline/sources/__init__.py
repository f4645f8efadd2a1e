"""Table, event and report sources and sinks."""

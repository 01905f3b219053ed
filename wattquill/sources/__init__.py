"""Table, workload and artifact sources and sinks."""

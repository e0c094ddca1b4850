"""Table adapters and sinks."""

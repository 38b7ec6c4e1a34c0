"""Relations over Structured Streaming."""

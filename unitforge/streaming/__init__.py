"""The declarative operators over streams: same functions, Structured Streaming underneath."""

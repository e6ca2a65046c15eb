"""The engine's stateful behaviours as Structured Streaming."""

"""Live advice: requests, coverage, sessions, state of contacts, late outcomes, as Structured Streaming."""

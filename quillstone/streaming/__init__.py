"""Structured Streaming: ingest that goes on where it stopped, and the state of jobs. Extensions: nothing here is in the surveyed system."""

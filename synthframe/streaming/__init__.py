"""Structured Streaming jobs over journal lines and timing events, with their batch twins."""

"""The queries of the engine."""

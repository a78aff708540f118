"""Structured Streaming forms of the decision engine and the merchant windows."""

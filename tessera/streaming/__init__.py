"""Serving policies over a stream of requests."""

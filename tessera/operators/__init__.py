"""Relational operators over pixels, pictures and request logs."""

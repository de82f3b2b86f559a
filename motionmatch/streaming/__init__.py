"""Attempts, history and feedback as streams."""

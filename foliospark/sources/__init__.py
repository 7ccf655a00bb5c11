"""Readers of listings, responses and events, and writers of results."""

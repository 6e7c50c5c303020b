"""Exports, site writes and alert payloads."""

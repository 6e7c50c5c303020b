"""Scans: scene catalogue, band tiles, feature collections, label geometry."""

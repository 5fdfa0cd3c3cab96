"""Scans of landed responses, pages and feeds; the source registry; job tables and snapshots."""

"""Relational building blocks: ranking, upsert, joins, similarity, components, rollups."""

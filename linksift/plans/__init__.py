"""Composite jobs: link assessment, scoring, history, digest, graph, rotation, reports, batch."""

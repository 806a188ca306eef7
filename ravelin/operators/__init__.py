"""Operators of the knowledge base: extraction, resolution, enrichment, search, graph, dossier, audit, store, SQL gate."""

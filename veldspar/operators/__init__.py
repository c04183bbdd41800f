"""Grids, graphs, clusters, searches and their evaluation over points (id, vec, a0, a1, ...) and queries (qid, qvec, l0, r0, ...)."""

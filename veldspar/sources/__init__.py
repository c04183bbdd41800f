"""Binary vector, attribute, graph, grid and truth files, and cached tables."""

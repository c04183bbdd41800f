"""Planning of searches: which cells a query visits, in which order, and by which strategy."""

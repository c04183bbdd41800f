"""Column expressions and block kernels over vectors, and box predicates."""

"""Graph operators over edges(src, dst, ...) and vertices(id, ...)."""

"""Spark jobs for large collections of complex-valued, multi-coil imaging arrays."""

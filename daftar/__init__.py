"""daftar: Spark jobs for building, running and measuring text retrieval over tables."""

__version__ = "0.1.0"

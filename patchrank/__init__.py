"""patchrank: position-aware localisation analytics as Spark DataFrame operators."""
__version__ = "0.1.0"

"""lodestep: decision-log analytics and training-data operators as PySpark plans."""

__version__ = "0.1.0"

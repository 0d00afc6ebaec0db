"""tracklake: interval, track and signal-matrix analytics on PySpark."""

__version__ = "0.1.0"

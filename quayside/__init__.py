"""Trade analytics as DataFrame transformations on Spark."""

__version__ = "0.1.0"

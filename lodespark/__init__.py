"""lodespark: claim, finding, event and training-data analytics as plain Spark plans."""

__version__ = "0.1.0"

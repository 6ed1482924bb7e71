"""mundspark: a PySpark engine for speech, transcript and text corpora."""

__version__ = "0.1.0"

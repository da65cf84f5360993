"""Jet-table analytics on PySpark: feature building, background subtraction, labelling,
sampling, exploration, tree models and reports, all as DataFrame jobs."""

__version__ = "0.1.0"

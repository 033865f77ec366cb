"""Curation of instruction-tuning dialogue data as Spark DataFrame operators."""

__version__ = "0.1.0"

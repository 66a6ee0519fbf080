"""Audit of machine-generated region labels as DataFrame operators."""

__version__ = "0.1.0"

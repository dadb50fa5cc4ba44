"""Readers."""

from .tables import load

__all__ = ["load"]

"""Scratch tables, as the rest of the library has them."""

from ..scratch import folder, save

__all__ = ["folder", "save"]

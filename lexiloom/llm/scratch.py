"""Intermediate tables of the operators; see :mod:`lexiloom.scratch`."""

from __future__ import annotations

from lexiloom.scratch import Scratch, shared_root

__all__ = ["Scratch", "shared_root"]

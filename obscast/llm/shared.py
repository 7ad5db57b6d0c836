"""Shared-folder helpers of the library, under the names that the operators use."""

from __future__ import annotations

from obscast.sources.shared import Scratch, remove, shared_dir, shared_path, stored

__all__ = ["Scratch", "cut", "remove", "shared_dir", "shared_path", "stored"]

cut = stored

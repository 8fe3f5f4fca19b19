"""Where inputs and outputs lie, from the environment with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Paths:
    """Folders of charts, procedure records and results, below one root unless named."""

    root: str = "."
    charts: str = ""
    records: str = ""
    results: str = ""

    @classmethod
    def from_environment(cls, prefix: str = "FIXWEAVE_") -> Paths:
        return cls(**{k: os.environ[f"{prefix}{k.upper()}"] for k in ("root", "charts", "records", "results") if f"{prefix}{k.upper()}" in os.environ})

    def of(self, name: str) -> str:
        """The folder ``name``: its own setting, else the folder of that name in the root."""
        return getattr(self, name) or f"{self.root.rstrip('/')}/{name}"

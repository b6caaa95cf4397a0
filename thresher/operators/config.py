"""Options of the pipeline, resolved when a plan is built."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from ..functions import classes as C

INACTIVE = ("off", "passthrough", "disabled")


@dataclass(frozen=True)
class Config:
    """Compression options; the ratio is the share of tokens to keep."""

    mode: str = "off"
    threshold_tokens: int = 2000
    last_turns: int = 2
    ratio: float = 0.5
    routing: dict[str, str] = field(default_factory=lambda: {"prose": "extract"})
    default_compressor: str = "verbatim"
    dedup: bool = True
    purge_after: int | None = 4
    placeholder: str = C.PURGED

    def __post_init__(self) -> None:
        if not self.mode:
            raise ValueError("mode must not be empty")
        if not 0 < self.ratio <= 1:
            raise ValueError("ratio must be above 0 and at most 1")
        if self.threshold_tokens < 0 or self.last_turns < 0:
            raise ValueError("threshold_tokens and last_turns must not be negative")

    @property
    def active(self) -> bool:
        return self.mode.lower() not in INACTIVE

    @property
    def ratio_millis(self) -> int:
        return int(self.ratio * 1000 + 0.5)

    def routes(self, known: set[str]) -> dict[str, str]:
        """Usable routes: unknown labels are ignored and unknown compressors are the default, with a warning."""
        out = {}
        for label, name in self.routing.items():
            if label not in C.LABELS:
                warnings.warn(f"unknown label {label!r} in routing", stacklevel=2)
            elif name not in known:
                warnings.warn(f"unknown compressor {name!r} in routing", stacklevel=2)
                out[label] = self.default_compressor
            else:
                out[label] = name
        return out

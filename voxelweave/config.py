"""Engine configuration: defaults and validation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields
from pathlib import Path

CUT_FIELDS, CUT_OPS = ("temperature", "density"), ("lt", "gt")


@dataclass(frozen=True)
class EngineConfig:
    """One run's settings. ``dx``, ``dy``, ``dz`` default to 1/n unless all three are given."""

    n: int
    step: int = 0
    gamma: float = 5.0 / 3.0
    cut_by: str = "temperature"
    cut_op: str = "lt"
    threshold: float = 1.0
    dx: float | None = None
    dy: float | None = None
    dz: float | None = None
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    connectivity: int = 6
    ghost_width: int = 1
    overlap_width: int = 1
    min_clump_cells: int = 1
    dims: tuple[int, int, int] = (1, 1, 1)
    periodic: tuple[bool, bool, bool] = (True, True, True)

    def __post_init__(self) -> None:
        if self.n <= 0:
            raise ValueError("n must be positive")
        if self.cut_by not in CUT_FIELDS or self.cut_op not in CUT_OPS:
            raise ValueError(f"cut must be one of {CUT_FIELDS} by one of {CUT_OPS}")
        if self.connectivity not in (6, 18, 26):
            raise ValueError("connectivity must be 6, 18 or 26")
        if self.ghost_width < 1 or not 1 <= self.overlap_width <= self.ghost_width:
            raise ValueError("need 1 <= overlap_width <= ghost_width")
        if self.overlap_width != 1:
            raise NotImplementedError("only an overlap of one cell is defined")
        if any(d < 1 or d > self.n for d in self.dims):
            raise ValueError("every dimension needs 1 to n bricks")

    @property
    def spacing(self) -> tuple[float, float, float]:
        own = (self.dx, self.dy, self.dz)
        return (1.0 / self.n,) * 3 if any(d is None for d in own) else own  # type: ignore[return-value]

    @classmethod
    def from_mapping(cls, values: dict) -> EngineConfig:
        """From a parsed mapping; unknown keys are reported and ignored."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            warnings.warn(f"unknown settings ignored: {', '.join(unknown)}", stacklevel=2)
        clean = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
        if isinstance(clean.get("periodic"), bool):  # one word for all axes
            clean["periodic"] = (clean["periodic"],) * 3
        return cls(**clean)

    @classmethod
    def from_yaml(cls, path: str | Path) -> EngineConfig:
        import yaml

        return cls.from_mapping(yaml.safe_load(Path(path).read_text()) or {})

"""Defaults of an analysis, closed over by plans; nothing here reads global state."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np

#: Grids and weights of the elastic nets, and the named profiles at which importance is asked.
ALPHA_GRID = (0.1, 0.3, 0.5, 0.7, 1.0, 1.3, 1.7, 2.0)
L1_GRID = (0.0, 0.2, 0.5, 0.8, 1.0)
INTERACTION_ALPHA_GRID = (0.01, 0.03, 0.1, 0.3, 0.7, 1.0, 1.3, 1.7, 2.0)
INTERACTION_L1_GRID = (0.2, 0.5, 0.8, 1.0)
SUBGROUPS = {
    "paediatric_lowGAA": {"age_at_onset": 10.0, "GAA1": 500.0, "dur": 5.0},
    "paediatric_highGAA": {"age_at_onset": 10.0, "GAA1": 900.0, "dur": 5.0},
    "adult_lowGAA": {"age_at_onset": 25.0, "GAA1": 500.0, "dur": 5.0},
    "adult_highGAA": {"age_at_onset": 25.0, "GAA1": 900.0, "dur": 5.0},
}


@dataclass(frozen=True)
class Config:
    """Sizes of folds and bootstraps, elastic nets, and the profiles that importance is asked at."""

    folds: int = 5
    inner_folds: int = 5
    bootstrap: int = 201
    seed: int = 42
    alpha: float = 1.3
    l1_ratio: float = 0.0
    alpha_grid: tuple[float, ...] = ALPHA_GRID
    l1_grid: tuple[float, ...] = L1_GRID
    interaction_alpha: float = 0.3
    interaction_l1_ratio: float = 0.8
    interaction_alpha_grid: tuple[float, ...] = INTERACTION_ALPHA_GRID
    interaction_l1_grid: tuple[float, ...] = INTERACTION_L1_GRID
    subgroups: dict[str, dict[str, float]] = field(default_factory=lambda: {k: dict(v) for k, v in SUBGROUPS.items()})


def seed_driver(seed: int = 42) -> None:
    """Seed the driver's generators. Executors never use a global one: their draws are hashes of keys."""
    random.seed(seed)
    np.random.seed(seed)

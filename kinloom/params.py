"""Parameters of the linkage pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BlockingParams:
    """Rarest keys kept per record and type (left side: ``*1``), frequency caps and candidates kept."""

    nk: int = 2
    nk1: int = 3
    na: int = 4
    na1: int = 7
    naa1: int = 5
    ng: int = 3
    ng1: int = 6
    single_df: int = 3
    cap1: int = 30
    capo: int = 150
    k_o: int = 4
    k_1: int = 18

    @property
    def naa(self) -> int:
        return self.na


@dataclass(frozen=True)
class DecisionParams:
    p_min: float = 0.01
    threshold: float = 0.775
    grid: tuple[float, ...] = tuple(round(0.30 + 0.025 * i, 3) for i in range(27))
    floor: float = 0.2
    missed: float = 0.1
    empty_scale: float = 1.0


@dataclass(frozen=True)
class VocabParams:
    least_pairs: int = 20
    prior: float = 0.02
    weight: float = 10.0
    bins: int = 10
    least_in_bin: int = 5


@dataclass(frozen=True)
class StageParams:
    plausible: float = 0.2
    confident: float = 0.5
    sibling: float = 0.30
    near: int = 85
    fold_seed: int = 11
    holdout_seed: int = 23
    holdout_percent: int = 15
    blend_seed: int = 77

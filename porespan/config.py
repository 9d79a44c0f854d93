"""Parameters of the volume pipeline."""

from __future__ import annotations

from dataclasses import dataclass

#: Labels of a voxel.
ROCK, BRINE, GAS = 0, 1, 2
#: Square metres to a darcy; published reference permeability in square metres; fallback voxel edge in metres.
M2_PER_DARCY, K_REFERENCE, VOXEL_EDGE = 9.869233e-13, 3.703e-13, 4.99684e-6


@dataclass(frozen=True)
class Config:
    """Immutable settings; an instance goes with every run."""

    gas_label: int = GAS
    n_keep: int = 8
    slab_depth: int = 64
    connectivity: int = 18
    crop_margin: int = 10
    area_fraction: float = 0.20
    regime_cutoff: str = "displacement"
    min_scans: int = 3
    track_distance: float = 1000.0
    thin_slices: int = 200

    def __post_init__(self) -> None:
        if not 1 <= self.n_keep <= 255:
            raise ValueError("n_keep must be from 1 to 255")
        if self.connectivity not in (6, 18, 26):
            raise ValueError("connectivity must be 6, 18 or 26")
        if self.regime_cutoff not in ("displacement", "transition"):
            raise ValueError("regime_cutoff must be displacement or transition")

"""Parameters of the analysis and their fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Values as shipped; `fallback()` has those that hold where a parameter isn't set."""

    # grid
    tile_size: int = 1024
    overlap: int = 256
    window_iomin: float = 0.5
    clear_border_cells: bool = True
    # core mask and blend
    close_kernel: int = 7
    min_fragment: int = 550
    mask_blur_sigma: float = 0.0
    background_fill: int = 255
    overlay_alpha: float = 0.65
    # matching
    enlarge_area_factor: float = 1.5
    elastic_expand_factor: float = 1.5
    elastic_min_reach: float = 20.0
    exclude_zero: bool = True
    core_min_inside: float = 0.97
    # dots
    background_l: float = 95.0
    seed_dilate: int = 3
    black_merge: float = 1.4
    red_merge: float = 2.0
    red_h: float = 3.0
    red_a_min: float = 14.0
    red_min_area: int = 5
    red_max_area: int = 400
    red_min_circ: float = 0.55
    red_min_solidity: float = 0.65
    red_ring_gap: int = 2
    red_ring_width: int = 5
    red_min_contrast: float = 7.0
    black_h: float = 5.0
    black_l_max: float = 58.0
    black_min_area: int = 3
    black_max_area: int = 260
    black_max_radius: float = 9.0
    black_min_circ: float = 0.40
    black_min_solidity: float = 0.50
    black_ring_gap: int = 2
    black_ring_width: int = 5
    black_min_contrast: float = 10.0
    black_min_ring_l: float = 30.0
    black_max_chroma: float = 24.0
    black_max_median_chroma: float = 22.0
    black_max_p90_chroma: float = 32.0
    black_p20_l_max: float = 56.0
    black_seed_dilate: int = 1
    black_very_dark_l: float = 40.0
    black_very_dark_contrast: float = 10.0
    # verdicts
    min_cep17: int = 2
    amplification_ratio: float = 2.0
    asco_ratio: float = 2.0
    asco_copy_positive: float = 6.0
    asco_copy_equivocal: float = 4.0
    ith_min_fraction: float = 0.05
    ghost_distance: float = 6.0
    # execution: not part of the fingerprint
    workers: int = 4
    batch_size: int = 4

    RUNTIME = ("workers", "batch_size")

    @classmethod
    def fallback(cls, **changes) -> Config:
        """The values that hold where nothing is configured."""
        return cls(
            overlay_alpha=0.5, background_fill=0, elastic_expand_factor=1.5, enlarge_area_factor=1.0, exclude_zero=False, core_min_inside=1.0, black_merge=3.0, red_merge=3.0,
            red_h=12.0, red_a_min=25.0, red_min_area=7, red_min_contrast=10.0, black_h=15.0, black_l_max=50.0, black_min_area=5, black_max_area=300, black_max_radius=7.0,
            black_min_circ=0.50, black_min_solidity=0.60, black_min_contrast=18.0, black_min_ring_l=35.0, black_max_chroma=18.0, black_max_median_chroma=15.0, black_max_p90_chroma=22.0,
            black_p20_l_max=45.0, black_seed_dilate=3, black_very_dark_l=38.0, black_very_dark_contrast=12.0, **changes,
        )

    def fingerprint(self) -> str:
        """Eight hex digits that change with any parameter but those of execution (C4)."""
        values = {k: v for k, v in dataclasses.asdict(self).items() if k not in self.RUNTIME}
        return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:8]

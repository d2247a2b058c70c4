"""Parameters with their defaults, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Detection:
    threshold: float = 0.5
    pixel_gap: int = 3
    min_area: int = 1
    max_area: int | None = None
    min_score: float = 0.0
    min_peak_probability: float = 0.0
    score_method: str = "topk_mean"
    topk_fraction: float = 0.05


@dataclass(frozen=True)
class Sweep:
    thr_min: float = 0.0
    thr_max: float = 1.0
    n_points: int = 51
    nbins: int = 4096
    pixel_gap: int = 2
    psf_width: float = 40.0


@dataclass(frozen=True)
class Mixture:
    fractions: dict[str, float] = field(default_factory=lambda: {"missed": 0.4, "detected": 0.3, "background": 0.3})
    seed: int = 1337


@dataclass(frozen=True)
class Config:
    detection: Detection = Detection()
    sweep: Sweep = Sweep()
    mixture: Mixture = field(default_factory=Mixture)

    def validate(self) -> Config:
        """Raises ValueError with every value that is out of range."""
        d, s, m = self.detection, self.sweep, self.mixture
        wrong = [
            text
            for text, bad in (
                ("threshold must be from 0 to 1", not 0 <= d.threshold <= 1), ("pixel_gap must not be negative", d.pixel_gap < 0 or s.pixel_gap < 0),
                ("topk_fraction must be over 0 and at most 1", not 0 < d.topk_fraction <= 1), ("score_method is unknown", d.score_method not in ("max", "mean", "sum", "topk_mean")),
                ("thr_min must be below thr_max", s.thr_min >= s.thr_max), ("n_points must be at least 2", s.n_points < 2), ("nbins must be at least 2", s.nbins < 2),
                ("fractions must not be negative", any(f < 0 for f in m.fractions.values())), ("fractions must have a positive sum", sum(m.fractions.values()) <= 0),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

"""Run options.  Defaults are fixed values of the analysis contract."""

from __future__ import annotations

from dataclasses import dataclass, field

# Per-mode detection gates: minimum |effect| and minimum rows in a bin.
MODE_GATES = {
    "demo": {"min_effect": 0.15, "min_bin_rows": 20},
    "production": {"min_effect": 0.20, "min_bin_rows": 30},
}

# Per-mode survival gates of the bootstrap check.
BOOTSTRAP_GATES = {
    "demo": {
        "presence": 0.5,
        "min_variance": 1e-7,
        "min_range": 0.01,
        "min_support": 0.005,
        "max_support": 0.98,
    },
    "production": {
        "presence": 0.7,
        "min_variance": 1e-5,
        "min_range": 0.05,
        "min_support": 0.01,
        "max_support": 0.95,
    },
}


@dataclass(frozen=True)
class Options:
    """Everything a discovery run can be told."""

    target: str = "target"
    key: str = "row_key"
    time_column: str | None = None
    group_column: str | None = None
    models: tuple[str, ...] = ("linear",)
    cv_folds: int = 5
    cv_strategy: str = "auto"
    cv_gap: int = 0
    test_size: float = 0.2
    seed: int = 42
    bootstrap_iterations: int = 50
    mode: str = "demo"
    problem_type: str | None = None
    ridge_alpha: float = 1.0
    n_bins: int = 5
    fdr_alpha: float = 0.05
    top_patterns: int = 20
    top_interactions: int = 5
    cluster: bool = True
    variance_regimes: bool = True
    column_types: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 2 <= self.cv_folds <= 20:
            raise ValueError("cv_folds must be between 2 and 20")
        if not 10 <= self.bootstrap_iterations <= 500:
            raise ValueError("bootstrap_iterations must be between 10 and 500")
        if self.mode not in MODE_GATES:
            raise ValueError(f"mode must be one of {sorted(MODE_GATES)}")

    @property
    def gates(self) -> dict:
        return MODE_GATES[self.mode]

    @property
    def bootstrap_gates(self) -> dict:
        return BOOTSTRAP_GATES[self.mode]

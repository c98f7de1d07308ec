"""Engine settings. A zero stands for "unset" and gives the default."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of the detectors; amounts in native units, spans in seconds."""

    min_transfer_value: float = 0.001
    min_shared_counterparties: int = 3
    temporal_window: float = 60.0
    fan_threshold: int = 5
    loop_max_depth: int = 6
    min_heuristic_support: int = 1
    min_cluster_size: int = 2
    cashout_window: float = 300.0
    pass_through_window: float = 1800.0
    amount_ratio: float = 0.05
    forwarding_tolerance: float = 0.01
    max_pattern_size: int = 100
    high_value: float = 10.0
    structuring_window: float = 1800.0
    structuring_min_tx: int = 4
    structuring_max_cv: float = 0.05
    smurf_senders: int = 6
    smurf_max_age: float = 604800.0
    micro_max: float = 0.1
    micro_count: int = 8
    micro_total: float = 1.0
    max_hops: int = 3
    branching: int = 3
    convergence_senders: int = 5
    dormancy_seconds: float = 2592000.0
    activation_value: float = 1.0
    reaggregation_inputs: int = 4
    reaggregation_ratio: float = 0.70
    service_tx: int = 200
    service_degree: int = 25

    def __post_init__(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name):
                object.__setattr__(self, f.name, f.default)

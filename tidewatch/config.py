"""Settings of the detector.  Builders take a Settings, so that window length and scale are parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Event weights, an event without one weighs DEFAULT_WEIGHT.
WEIGHTS = {
    "distributed_connection_burst": 0.50,
    "synchronized_request_timing": 0.40,
    "incomplete_handshake_spike": 0.35,
    "geographic_entropy_reduction": 0.30,
    "session_duration_anomaly": 0.25,
    "per_source_request_spike": 0.20,
    "protocol_compliance_violation": 0.15,
    "user_agent_homogeneity": 0.10,
}
DEFAULT_WEIGHT = 0.05

# The ordered attack template.
TEMPLATE = ("distributed_connection_burst", "per_source_request_spike", "incomplete_handshake_spike", "geographic_entropy_reduction")

# Feature names in the order that breaks ties.
FEATURES = (
    "new_connection_rate",
    "concurrent_connection_count",
    "mean_connection_duration",
    "variance_connection_duration",
    "handshake_completion_ratio",
    "request_rate",
    "inter_request_timing_variance",
    "protocol_compliance_score",
    "total_request_rate",
    "unique_source_count",
    "geographic_entropy",
    "backend_error_rate",
    "response_latency_mean",
    "source_diversity_per_minute",
    "geo_distribution_shift_rate",
    "cross_source_timing_correlation",
    "protocol_frequency_ratio",
    "payload_entropy_proxy",
)

#: Rule events in the order of their evaluation; they follow the features within a window.
RULES = ("incomplete_handshake_spike", "session_duration_anomaly", "per_source_request_spike", "user_agent_homogeneity", "distributed_connection_burst", "synchronized_request_timing")


# Names of settings files -> fields.
PARAMETERS = {
    "ewma_alpha": "alpha",
    "zscore_threshold": "tau_z",
    "accumulator_decay": "decay",
    "accumulator_threshold": "theta",
    "correlation_window": "window",
    "mitigation_tier1_threshold": "tier1",
    "mitigation_tier2_threshold": "tier2",
    "mitigation_tier3_threshold": "tier3",
    "mitigation_deescalation_score": "release3",
    "mitigation_deescalation_time": "hold3",
}


# The defaults.
@dataclass(frozen=True)
class Settings:
    """Defaults are those of a 5 s observation interval; scaled() stretches all times."""

    dt: float = 5.0
    window: float = 60.0
    alpha: float = 0.3
    decay: float = 0.8
    tau_z: float = 3.0
    theta: float = 5.0
    epsilon: float = 1e-9
    boost: float = 0.2
    #: (ids in order, how many of them must first appear in that order) of each pattern that earns the boost.
    templates: tuple[tuple[tuple[str, ...], int], ...] = ((TEMPLATE, 3),)
    alert: float = 0.50
    tier1: float = 0.70
    tier2: float = 0.85
    tier3: float = 0.90
    release3: float = 0.60
    hold1: float = 60.0
    hold3: float = 120.0
    hold_all: float = 300.0
    cooldown: float = 120.0
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    default_weight: float = DEFAULT_WEIGHT
    incomplete_per_source: int = 100
    incomplete_per_subnet: int = 500
    slow_tiny: int = 10
    slow_tiny_bytes: int = 100
    slow_tiny_seconds: float = 5.0
    slow_many: int = 20
    slow_many_bytes: int = 1024
    slow_many_seconds: float = 10.0
    rate_start: float = 50.0
    rate_multiplier: float = 10.0
    rate_smoothing: float = 0.1
    agents_least_flows: int = 100
    agents_diversity: float = 0.1
    burst_sources: int = 50
    burst_window: float = 5.0
    timing_sources: int = 100
    timing_cv: float = 0.7

    def scaled(self, dt: float, **changes) -> Settings:
        """The same detector with another interval: every duration grows alike."""
        k = dt / self.dt
        times = {n: getattr(self, n) * k for n in ("window", "hold1", "hold3", "hold_all", "cooldown", "burst_window")}
        return Settings(**(asdict(self) | times | {"dt": dt} | changes))

    @classmethod
    def of(cls, parameters: dict, weights: dict | None = None) -> Settings:
        """From the mappings of settings files; unknown names are ignored, missing ones keep their defaults."""
        known = {PARAMETERS[k]: float(v) for k, v in parameters.items() if k in PARAMETERS}
        return cls(**known, **({"weights": {k: float(v) for k, v in weights.items()}} if weights else {}))

    def to_dict(self) -> dict:
        return asdict(self)

"""Names and thresholds shared by every operator.

The values in this module are fixed by the behaviour being matched: dimension names, rollup key
order, gates and floors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

# Dimensions present on every event, and those only present once an ad was sold.
DIMENSIONS = (
    "ad_format",
    "app_category",
    "publisher_tier",
    "region",
    "country",
    "device_model",
    "os_version",
    "app_id",
)
FILLED_ONLY_DIMENSIONS = ("advertiser_vertical", "campaign_type", "advertiser_id")
SURROGATE_DIMENSIONS = ("geo_device_id",)

# The pairs a sweep looks at.
SWEEP_PAIRS = (
    ("region", "os_version"),
    ("publisher_tier", "os_version"),
    ("app_category", "os_version"),
    ("region", "device_model"),
    ("app_category", "ad_format"),
    ("country", "ad_format"),
)

# Order in which pair keys are spelled. Writer and readers both use this list.
PAIRABLE = (
    "app_category",
    "country",
    "publisher_tier",
    "region",
    "ad_format",
    "device_model",
    "os_version",
    "advertiser_vertical",
    "campaign_type",
)
ENTITY_DIMENSIONS = ("app_id", "advertiser_id")

Cut = tuple[str, ...]

ROLLUP_CUTS: tuple[Cut, ...] = (
    *((d,) for d in PAIRABLE),
    *((d,) for d in ENTITY_DIMENSIONS),
    *combinations(PAIRABLE, 2),
)

MEASURES = ("events", "fills", "impressions", "clicks", "revenue")


def cut_key(cut: Cut) -> str:
    """The value the rollup's ``dim`` column takes for a cut."""
    return "|".join(cut)


ROLLUP_KEYS = tuple(cut_key(c) for c in ROLLUP_CUTS)


@dataclass(frozen=True)
class Thresholds:
    """Every gate in one place; tests and checking SQL read the same object."""

    baseline_weeks: int = 4
    min_baseline_days: int = 2
    spread_floor: float = 0.005
    mad_scale: float = 1.4826
    growth_min_points: int = 14
    growth_max_abs: float = 0.15

    platform_pct: float = 3.0
    platform_sigma: float = 2.5

    segment_min_requests: int = 150
    segment_pct: float = 10.0
    segment_sigma: float = 5.0
    window_span_days: int = 7

    cause_share_pct: float = 0.5
    cause_pp: float = 2.0
    cause_pct: float = 5.0
    band_pp: float = 0.75
    band_pct: float = 2.0
    max_rounds: int = 4

    uniform_move: float = 1.0
    uniform_share_pct: float = 1.0
    uniform_segments: int = 8
    uniform_spread: float = 0.25

    material_share_pct: float = 5.0
    material_platform_pp: float = 0.5

    classify_advertisers_pct: float = -10.0
    classify_requests_pct: float = 15.0
    classify_render_pp: float = -2.0
    classify_ecpm_pct: float = 10.0

    recovery_pct: float = 3.0

    default_rows: int = 25
    max_group_by: int = 2
    recent_days: int = 7


T = Thresholds()

# Metrics a sweep covers when none are named.
SWEEP_METRICS = ("revenue", "requests", "fill_rate", "ecpm", "ctr", "rpr", "render_rate")

# Who owns each kind of cause.
OWNERS = {
    "demand_change": "Sales / account management",
    "supply_change": "Publisher ops",
    "technical_break": "Engineering",
    "mix_shift": "Nobody — nothing is broken",
    "seasonality": "Nobody — expected pattern",
    "not_localizable": "Platform / on-call",
    "no_anomaly": "Nobody",
}

# Which step of request -> fill -> impression -> click a metric describes.
FUNNEL_STEPS = {
    "fill_rate": ("step", "request", "fill"),
    "render_rate": ("step", "fill", "impression"),
    "ctr": ("step", "impression", "click"),
    "ecpm": ("price", "impression", None),
    "rpr": ("price", "request", None),
    "requests": ("volume", "request", None),
    "impressions": ("volume", "impression", None),
    "revenue": ("volume", "impression", None),
}


def dimensions_for(metric: str) -> tuple[str, ...]:
    """Advertiser dimensions are empty on unfilled rows, so two metrics cannot be cut by them."""
    if metric in ("fill_rate", "requests"):
        return DIMENSIONS
    return DIMENSIONS + FILLED_ONLY_DIMENSIONS


def sweep_cuts(metric: str | None = None) -> tuple[Cut, ...]:
    """Cuts a sweep of ``metric`` covers; all sweep cuts when no metric is given."""
    dims = dimensions_for(metric) if metric else DIMENSIONS + FILLED_ONLY_DIMENSIONS
    pairs = tuple(p for p in SWEEP_PAIRS if p[0] in dims and p[1] in dims)
    return tuple((d,) for d in dims) + pairs

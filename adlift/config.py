"""Run configuration: launch dates, comparison windows, thresholds and rules.

Every operator takes its dates and rules from a :class:`LaunchConfig`; nothing
reads the wall clock (the end date is a required parameter) and nothing is
formatted into SQL text, so Catalyst sees plain literals it can fold and push
into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values used by the job being reproduced;
# they are listed here together, in their natural order, and nowhere else.
# ---------------------------------------------------------------------------

#: page that marks off-site (exchange) delivery
OFFSITE_PAGE = "adx-display"
#: display scope
SCOPE_CAMPAIGN_TYPE = "PROGRAMMATIC"
SCOPE_PRODUCT_TYPE = "DSP_SELFSERVICE"
SCOPE_EXCLUDED_LINE_TYPES = ("VIDEO", "SOCIAL")
#: inventory settings of a line item
INVENTORY_OFF = "OFF"
INVENTORY_IN_PLUS_OFF = "MELI_OFF"
INVENTORY_IN = ("IN", "MELI")
#: inventory categories, their priority and display labels
ONLY_IN, IN_PLUS_OFF, ONLY_OFF = "ONLY_IN", "IN_PLUS_OFF", "ONLY_OFF"
INV_ORDER = (ONLY_IN, IN_PLUS_OFF, ONLY_OFF)
INV_PRIORITY = {ONLY_OFF: 2, IN_PLUS_OFF: 1, ONLY_IN: 0}
INV_LABELS = {ONLY_IN: "Solo In-MELI", IN_PLUS_OFF: "In + Off", ONLY_OFF: "Solo Off"}
#: destination subtypes that count as an external landing page
EXTERNAL_DESTINATION_SUBTYPES = ("CLICK_OFF", "CLICK_OFF_SAFE")
#: creative format looked for inside the images JSON, and excluded advertisers
CREATIVE_FORMAT_TYPE = "iab_picture"
EXCLUDED_CREATIVE_ADVERTISERS = (710,)
#: campaign targets
AWARENESS_TARGETS = ("REACH", "IMPRESSION", "IMPRESSIONS")
CONVERSION_TARGETS = ("CPA", "CONVERSION", "CONVERSIONS")
#: strategy labels
AWARENESS, CONSIDERACION, CONVERSION = "AWARENESS", "CONSIDERACION", "CONVERSION"
#: verticals that are not endemic to the marketplace
NON_ENDEMIC_VERTICALS = (
    "TRAVEL_AND_LEISURE",
    "TELECOMMUNICATIONS",
    "ENTERTAINMENT",
    "ENTERTAINMENT_AND_MEDIA",
    "GOVERNMENT",
    "FINANCIAL_SERVICES",
    "EDUCATION_AND_TRAINING",
    "BUSINESS_SERVICES",
    "VIS",
    "VIS_MOTORS",
    "VIS_RE",
    "VIS_RE_DEVELOPMENTS",
    "VIS_RE_REALTORS",
    "VIS_VEHICLE_PARTS_AND_ACCESSORIES",
)
#: vertical values that mean "no information" (also non-endemic)
NO_INFO_VERTICALS = ("NONE", "OTROS", "OTHERS", "NO INFORMADO", "", "UNKNOWN", "OTHER")
NON_ENDEMIC_PREFIX = "VIS_"
#: site code -> label
SITE_LABELS = {
    "MLA": "Argentina",
    "MLB": "Brasil",
    "MLC": "Chile",
    "MLM": "México",
    "MCO": "Colombia",
    "MLU": "Uruguay",
    "MPE": "Perú",
}
#: thresholds and report sizes
MIN_SPEND_USD = 100
CANNIBALISATION_PCT = -10
TOP_ENDEMIC = 15
TOP_OPPORTUNITIES = 15
TOP_NON_ENDEMIC = 10
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class StrategyRules:
    """Maps a campaign target to a strategy.

    ``groups`` are tried in order; the first group whose values contain the
    (optionally upper-cased) target wins.  ``default=None`` keeps the target
    itself (a SQL ``ELSE target``); a string replaces every other value,
    NULL included.
    """

    groups: tuple[tuple[str, tuple[str, ...]], ...]
    upper: bool = False
    default: str | None = None

    def targets(self) -> tuple[str, ...]:
        return tuple(v for _, vals in self.groups for v in vals)


# The four classifiers of the source job disagree on purpose (ROAS / CPL /
# case); each extract keeps its own.
STRATEGY_NETWORK = StrategyRules(
    groups=(
        (AWARENESS, AWARENESS_TARGETS),
        (CONSIDERACION, ("CPC",)),
        (CONVERSION, CONVERSION_TARGETS + ("ROAS", "CPL")),
    )
)
STRATEGY_POPULATION = StrategyRules(
    groups=(
        (AWARENESS, AWARENESS_TARGETS),
        (CONVERSION, CONVERSION_TARGETS + ("CPL",)),
        (CONSIDERACION, ("CPC",)),
    )
)
STRATEGY_ADOPTERS = StrategyRules(
    groups=((AWARENESS, AWARENESS_TARGETS), (CONVERSION, CONVERSION_TARGETS)),
    upper=True,
    default=CONSIDERACION,
)
STRATEGY_CREATIVE = StrategyRules(
    groups=(
        (AWARENESS, AWARENESS_TARGETS),
        (CONSIDERACION, ("CPC",)),
        (CONVERSION, CONVERSION_TARGETS + ("ROAS",)),
    )
)

# Target allow-lists per extract (none for adopters and first-timers).
TARGETS_NETWORK = AWARENESS_TARGETS + ("CPC",) + CONVERSION_TARGETS + ("ROAS", "CPL")
TARGETS_POPULATION = AWARENESS_TARGETS + ("CPC",) + CONVERSION_TARGETS + ("CPL",)
TARGETS_CREATIVE = AWARENESS_TARGETS + ("CPC",) + CONVERSION_TARGETS + ("ROAS",)


WINDOW_POLICIES = ("reference", "equal")


def windows(launch: date, analysis_end: date, policy: str = "reference") -> tuple[date, date, int]:
    """Return ``(before_start, before_end, n_days)`` for a launch.

    ``n_days = max((analysis_end - launch).days, 1)``.  The after window is
    ``launch .. analysis_end`` inclusive (n_days + 1 days once the end is past
    the launch).  ``"reference"`` makes the before window ``n_days`` long,
    ending the day before launch — one day shorter than the after window, as
    in the job being reproduced.  ``"equal"`` makes both windows the same
    length.  An end before the launch gives an empty after window, not an
    error.
    """
    if policy not in WINDOW_POLICIES:
        raise ValueError(f"window policy must be one of {WINDOW_POLICIES}, got {policy!r}")
    n = max((analysis_end - launch).days, 1)
    length = n if policy == "reference" else n + 1
    return launch - timedelta(days=length), launch - timedelta(days=1), n


def _as_date(d: date | str) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


@dataclass(frozen=True)
class LaunchConfig:
    """Dates, thresholds and classification rules of one launch analysis."""

    launch_date: date
    analysis_end: date
    history_start: date
    min_spend: float = MIN_SPEND_USD
    window_policy: str = "reference"
    cannibalisation_pct: float = CANNIBALISATION_PCT
    excluded_creative_advertisers: tuple[int, ...] = EXCLUDED_CREATIVE_ADVERTISERS
    creative_format: str = CREATIVE_FORMAT_TYPE
    non_endemic_verticals: tuple[str, ...] = NON_ENDEMIC_VERTICALS
    site_labels: dict[str, str] = field(default_factory=lambda: dict(SITE_LABELS))

    def __post_init__(self) -> None:
        object.__setattr__(self, "launch_date", _as_date(self.launch_date))
        object.__setattr__(self, "analysis_end", _as_date(self.analysis_end))
        object.__setattr__(self, "history_start", _as_date(self.history_start))
        if self.window_policy not in WINDOW_POLICIES:
            raise ValueError(f"unknown window policy {self.window_policy!r}")

    def __hash__(self) -> int:  # site_labels is a dict
        return hash((self.launch_date, self.analysis_end, self.history_start, self.min_spend))

    @property
    def before_start(self) -> date:
        return windows(self.launch_date, self.analysis_end, self.window_policy)[0]

    @property
    def before_end(self) -> date:
        return windows(self.launch_date, self.analysis_end, self.window_policy)[1]

    @property
    def days_after(self) -> int:
        return windows(self.launch_date, self.analysis_end, self.window_policy)[2]

    @property
    def history_end(self) -> date:
        return self.launch_date - timedelta(days=1)

    def extract_record(self) -> dict:
        """The settings that the five extracts depend on (sectors, labels and
        the cannibalisation threshold only change the tables made of them)."""
        return {
            "launch_date": self.launch_date.isoformat(),
            "analysis_end": self.analysis_end.isoformat(),
            "history_start": self.history_start.isoformat(),
            "before_start": self.before_start.isoformat(),
            "min_spend": float(self.min_spend),
            "excluded_creative_advertisers": sorted(self.excluded_creative_advertisers),
            "creative_format": self.creative_format,
        }

    def as_record(self) -> dict:
        """The config record of the report bundle (dates as ISO text)."""
        return {
            "oo_start": self.launch_date.isoformat(),
            "analysis_end": self.analysis_end.isoformat(),
            "before_start": self.before_start.isoformat(),
            "before_end": self.before_end.isoformat(),
            "days_after": self.days_after,
            "adx_min_usd": self.min_spend,
            "history_start": self.history_start.isoformat(),
            "non_endemic": sorted(self.non_endemic_verticals),
            "sites_lbl": dict(self.site_labels),
        }


#: windows used by every fixture query (see FIXTURES.md)
FIXTURE_CONFIG = LaunchConfig(
    launch_date=date(1999, 7, 1),
    analysis_end=date(1999, 12, 31),
    history_start=date(1998, 7, 1),
    min_spend=100,
)

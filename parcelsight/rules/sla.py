"""Promised-time (SLA) rules, in match order."""

from dataclasses import dataclass


@dataclass(frozen=True)
class SlaRule:
    """One carrier rule. `carrier` / `account` are tokens of which any must occur."""

    name: str
    carrier: tuple = ()
    account: tuple = ()
    exclude: tuple = ()
    unit: str = "days"
    drop_only: bool = False          # lanes keyed by destination alone
    payment_split: bool = False      # lanes keyed by payment mode too
    default_tat: float | None = None
    has_default_lanes: bool = False  # second warehouse-keyed lane table
    has_city_lanes: bool = False     # last-resort city-to-city table
    basis: str = "ofd1"              # or "delivery"
    ignore_edd: bool = False
    grace_hours: float | None = None
    offset_days: float = 0.0


SLA_RULES = [
    SlaRule("Bluedart", carrier=("blue", "dart"), exclude=("reverse", "rvp"),
            unit="hours", drop_only=True),
    SlaRule("Delhivery NDD", carrier=("delhivery",), account=("ndd",), exclude=("reverse",),
            default_tat=3.0, basis="delivery", ignore_edd=True),
    SlaRule("Swift NDD", carrier=("swift", "goswift"), account=("ndd",),
            exclude=("reverse", "revers"), default_tat=3.0, basis="delivery", ignore_edd=True),
    SlaRule("GoSwift", carrier=("swift", "goswift"), exclude=("reverse", "revers"),
            has_default_lanes=True, has_city_lanes=True),
    SlaRule("Elastic Run", account=("elasticrun", "elastic run"),
            exclude=("reverse", "revers", "rvp"), drop_only=True, basis="delivery",
            ignore_edd=True),
    SlaRule("Skye Air", account=("skye", "sky air"), exclude=("reverse", "revers", "rvp"),
            drop_only=True, grace_hours=15.0),
    SlaRule("Shadowfax Large", carrier=("shadowfax", "shadofax"), account=("large",),
            exclude=("reverse", "revers", "rvp"), default_tat=3.0, basis="delivery",
            ignore_edd=True),
    SlaRule("Shadowfax", carrier=("shadowfax", "shadofax"),
            exclude=("reverse", "revers", "rvp"), default_tat=3.0, basis="delivery",
            ignore_edd=True, offset_days=1.0),
    SlaRule("Shiprocket", carrier=("shiprocket",), exclude=("reverse", "revers", "rvp"),
            unit="hours", drop_only=True, default_tat=72.0, basis="delivery"),
]

REVERSE_TAT_DAYS = 45

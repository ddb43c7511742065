"""Promised-time (SLA) matching, lane lookups, overrides and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.scalars import (
    contains_any_sql, digits, lookup, pick, text, to_number)
from parcelsight.rules.geo import PICKUP_CITY_ALIAS
from parcelsight.rules.sla import REVERSE_TAT_DAYS, SLA_RULES, SlaRule
from parcelsight.session import rule_table


def add_rule(df: DataFrame, rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Add ``rule_ix`` and ``rule``: the first rule whose tokens fit carrier and account."""
    branches = []
    for i, r in enumerate(rules):
        tests = [contains_any_sql(column, tokens) for column, tokens in
                 (("_car", r.carrier), ("_acc", r.account)) if tokens]
        if r.exclude:
            tests.append(f"NOT {contains_any_sql('_car', r.exclude)}")
            tests.append(f"NOT {contains_any_sql('_acc', r.exclude)}")
        branches.append(f"WHEN {' AND '.join(tests)} THEN {i}")
    low = df.withColumns({"_car": F.lower(text(F.col("carrier"))),
                          "_acc": F.lower(text(F.col("account")))})
    return low.withColumn("rule_ix", F.expr(f"CASE {' '.join(branches)} END")) \
        .withColumn("rule", pick(F.col("rule_ix"), [r.name for r in rules])).drop("_car", "_acc")


def _rules_with(rules: list[SlaRule], attribute: str) -> list[str]:
    return [r.name for r in rules if getattr(r, attribute)]


def promise_table(lanes: DataFrame | None, overrides: DataFrame | None,
                  rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """(promise_key, promises): all promises of a rule for a pincode, by where a parcel starts.

    ``promises`` maps 'primary <hub>', 'default <hub>' and 'override <origin>' to days or hours;
    rules that look at the destination alone have hub '*', and an override from anywhere has origin
    ANY. A map has a few entries for each warehouse, so the table has no more rows than there are
    pincodes of a rule, whatever the number of shipments. Default lanes count for the rules that
    own such a table.
    """
    parts = []
    if lanes is not None:
        owned = (F.col("tier") == "primary") | (
            (F.col("tier") == "default") & F.col("rule").isin(_rules_with(rules, "has_default_lanes")))
        hub = F.coalesce("warehouse", F.lit("*"))
        parts.append(lanes.where(owned).select(
            "rule", F.col("drop_pin").alias("drop"), F.concat_ws(" ", "tier", hub).alias("place"), "tat"))
    if overrides is not None:
        parts.append(override_lookup(overrides).select(
            F.col("carrier_rule").alias("rule"), F.col("pincode").alias("drop"),
            F.concat_ws(" ", F.lit("override"), "origin_pin").alias("place"), "tat"))
    single = reduce(DataFrame.unionByName, parts).groupBy("rule", "drop", "place").agg(
        F.max("tat").alias("tat"))
    return single.groupBy(F.concat_ws("|", "rule", "drop").alias("promise_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "tat"))).alias("promises"))


def add_promises(df: DataFrame, lanes: DataFrame | None, overrides: DataFrame | None,
                 rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Add ``tat_primary``, ``tat_default``, ``overridden`` and ``tat_override`` by one join.

    Which rules are overridden is a scalar of at most one name a rule. An override from the
    parcel's own origin comes before one from anywhere. The promises are broadcast: their number is
    that of pincodes of a rule, and the shipments, the widest rows there are, stay where they are.
    """
    key = F.concat(F.col("rule"), F.lit("|"), digits(F.col("drop_pin")))
    hub = F.when(pick(F.col("rule_ix"), [r.drop_only for r in rules]), F.lit("*")).otherwise(F.col("hub"))
    found = df.withColumn("_key", key).join(
        F.broadcast(promise_table(lanes, overrides, rules)), F.col("_key") == F.col("promise_key"), "left")

    def promise(kind: str, place: Column) -> Column:
        return F.element_at("promises", F.concat(F.lit(f"{kind} "), place))

    out = found
    if lanes is not None:
        out = out.withColumns({"tat_primary": promise("primary", hub),
                               "tat_default": promise("default", hub)})
    if overrides is not None:
        named = overrides.agg(F.collect_set("carrier_rule").alias("names"))
        out = out.withColumns({
            "overridden": F.coalesce(F.array_contains(named.scalar(), F.col("rule")), F.lit(False)),
            "tat_override": F.coalesce(promise("override", digits(F.col("pickup_pin"))),
                                       promise("override", F.lit("ANY")))})
    return out.drop("_key", "promise_key", "promises")


def add_lane_tat(df: DataFrame, lanes: DataFrame, rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Add ``tat_primary`` and ``tat_default``."""
    return add_promises(df, lanes, None, rules)


def add_payment_tat(df: DataFrame, lanes: DataFrame) -> DataFrame:
    """Add ``tat_payment`` from lanes keyed by payment mode.

    The mode is settled per (rule, hub): the shipment's own if the hub has it, else PREPAID,
    else the first one; only then is the pincode looked up.
    """
    modes = lanes.groupBy(F.col("rule").alias("m_rule"), F.col("warehouse").alias("m_hub")).agg(
        F.collect_set("payment").alias("modes"))
    settled = df.join(modes, (F.col("rule") == F.col("m_rule")) & (F.col("hub") == F.col("m_hub")),
                      "left").withColumn(
        "_mode", F.when(F.array_contains("modes", F.col("payment")), F.col("payment"))
        .when(F.array_contains("modes", F.lit("PREPAID")), F.lit("PREPAID"))
        .otherwise(F.array_min("modes")))
    table = lanes.select(F.col("rule").alias("l_rule"), F.col("warehouse").alias("l_hub"),
                         F.col("payment").alias("l_mode"), F.col("drop_pin").alias("l_drop"),
                         F.col("tat").alias("tat_payment"))
    return settled.join(table, (F.col("rule") == F.col("l_rule")) & (F.col("hub") == F.col("l_hub"))
                        & (F.col("_mode") == F.col("l_mode"))
                        & (digits(F.col("drop_pin")) == F.col("l_drop")), "left") \
        .drop("m_rule", "m_hub", "modes", "_mode", "l_rule", "l_hub", "l_mode", "l_drop")


def city_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(text(c), r"\s+", " "))


def add_city_tat(df: DataFrame, lanes: DataFrame, rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Add ``tat_city`` from the city-to-city lanes of rules that own some, with pickup aliases.

    The lanes are broadcast: there is one for each pair of cities of a rule, whatever is shipped.
    """
    owners = _rules_with(rules, "has_city_lanes")
    cities = lanes.where((F.col("tier") == "city") & F.col("rule").isin(owners)).groupBy(
        F.concat_ws("|", "rule", "pickup_city", "drop_city").alias("city_key")).agg(
        F.max("tat").alias("tat_city"))
    start, end = city_key(F.col("city")), city_key(F.col("drop_city"))
    keyed = df.withColumn("_from", start).withColumn(
        "_from", F.coalesce(lookup("_from", PICKUP_CITY_ALIAS), F.col("_from")))
    key = F.when(F.col("rule").isin(owners), F.concat_ws("|", F.col("rule"), F.col("_from"), end))
    return keyed.withColumn("_key", key).join(
        F.broadcast(cities), F.col("_key") == F.col("city_key"), "left").drop("_from", "_key", "city_key")


def clean_overrides(rows: DataFrame, rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Valid override rows: known rule, six-digit pins or ANY, numeric promise."""
    raw = F.upper(text(F.col("origin_pin")))
    d = digits(raw)
    origin = F.when(raw.isin("", "ANY"), F.lit("ANY")).when(F.length(d) == 6, d)
    return rows.select(
        "carrier_rule", origin.alias("origin_pin"), digits(F.col("pincode")).alias("pincode"),
        to_number(F.col("tat")).alias("tat"), "seq",
    ).where(F.col("origin_pin").isNotNull() & (F.length("pincode") == 6) & F.col("tat").isNotNull()
            & F.col("carrier_rule").isin([r.name for r in rules]))


def override_lookup(clean: DataFrame) -> DataFrame:
    """One promise per (rule, origin, pincode); the later duplicate wins."""
    return clean.groupBy("carrier_rule", "origin_pin", "pincode").agg(
        F.max_by("tat", "seq").alias("tat"))


def upsert_overrides(current: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """Replace one rule's override rows; an empty ``rows`` clears it."""
    return current.where(F.col("carrier_rule") != name).unionByName(
        clean_overrides(rows.withColumn("carrier_rule", F.lit(name))))


def override_meta(clean: DataFrame, rules: list[SlaRule] = SLA_RULES) -> DataFrame:
    """Per rule: unit, whether it is overridden and by how many rows."""
    table = rule_table(clean.sparkSession, "ix int,name string,unit string",
                       [(i, r.name, r.unit) for i, r in enumerate(rules)])
    counts = clean.groupBy(F.col("carrier_rule").alias("name")).agg(F.count("*").alias("rule_count"))
    return table.join(counts, "name", "left").select(
        "ix", "name", "unit", F.col("rule_count").isNotNull().alias("has_override"),
        F.coalesce("rule_count", F.lit(0)).cast("bigint").alias("rule_count"))


def add_override_tat(df: DataFrame, clean: DataFrame) -> DataFrame:
    """Add ``overridden`` and ``tat_override`` (exact origin first, then ANY)."""
    return add_promises(df, None, clean)


def score_sla(df: DataFrame, rules: list[SlaRule] = SLA_RULES,
              reverse_days: int = REVERSE_TAT_DAYS) -> DataFrame:
    """Add ``promised_tat``, ``tat_status`` and ``tat_margin`` from the resolved lookups.

    Returns are judged against a flat window, then rules that trust it against the carrier's
    own expected date, else against the promise in the rule's unit, by delivery or by first
    attempt. An undelivered shipment older than its promise is a breach.
    """
    ix = F.col("rule_ix")
    none = F.lit(None).cast("double")

    def rule(attribute: str) -> Column:
        return pick(ix, [getattr(r, attribute) for r in rules])

    reverse = F.col("is_reverse")
    by_edd = ~reverse & ix.isNotNull() & F.col("edd_days").isNotNull() & ~F.col("overridden") \
        & ~rule("ignore_edd")
    in_hours = rule("unit") == "hours"
    by_delivery = rule("basis") == "delivery"
    default = pick(ix, [None if r.default_tat is None else float(r.default_tat) for r in rules])
    built_in = F.coalesce("tat_primary", "tat_default", default, "tat_city") + rule("offset_days")
    lane = F.when(F.col("overridden"), F.col("tat_override")).otherwise(built_in)

    staged = df.withColumns({
        "promised_tat": F.when(reverse, F.lit(float(reverse_days)))
        .when(by_edd, F.col("edd_days").cast("double")).otherwise(lane),
        "_by_edd": by_edd,
        "_ofd": F.when(in_hours & ~by_edd, F.col("p2o")).otherwise(F.col("ofd1_days")),
        "_transit": F.when(in_hours & ~by_edd & ~reverse, F.col("p2d"))
        .otherwise(F.col("transit_days")),
        "_age": F.when(in_hours & ~by_edd & ~reverse, F.col("age_hours"))
        .otherwise(F.col("age_days")),
    })
    delivered = F.col("delivered")
    done = F.when(delivered & F.col("_transit").isNotNull(), F.col("_transit")) \
        .when(F.col("outcome") == "RTO", F.col("_ofd"))
    staged = staged.withColumns({
        "_actual": F.when(reverse, F.when(delivered, F.col("_transit")))
        .when(F.col("_by_edd") | by_delivery, done).otherwise(F.col("_ofd")),
        "_waiting": F.when(F.when(reverse, ~delivered).otherwise(F.col("outcome") == "FWD Pendency"),
                           F.col("_age")),
        "_grace": F.when(~reverse & ~F.col("_by_edd") & ~by_delivery,
                         F.col("p2o") <= pick(ix, [r.grace_hours for r in rules])),
    })
    promised, actual = F.col("promised_tat"), F.col("_actual")
    on_time = (actual <= promised) | F.coalesce(F.col("_grace"), F.lit(False))
    breach = F.col("_waiting") > promised
    return staged.withColumns({
        "tat_status": F.when(promised.isNull(), F.lit("No rule"))
        .when(actual.isNotNull(), F.when(on_time, F.lit("In TAT")).otherwise("Out of TAT"))
        .when(breach, F.lit("Out of TAT")).otherwise("Pending"),
        "tat_margin": F.when(promised.isNull(), none).when(actual.isNotNull(), promised - actual)
        .when(breach, promised - F.col("_waiting")),
    }).drop("_by_edd", "_ofd", "_transit", "_age", "_actual", "_waiting", "_grace")


def classify_sla(shipments: DataFrame, lanes: DataFrame, overrides: DataFrame,
                 rules: list[SlaRule] = SLA_RULES,
                 reverse_days: int = REVERSE_TAT_DAYS) -> DataFrame:
    """The whole SLA decision; re-run it after an override change to re-score."""
    matched = add_rule(shipments, rules)
    looked = add_promises(add_city_tat(matched, lanes, rules), lanes, overrides, rules)
    return score_sla(looked, rules, reverse_days).drop(
        "tat_primary", "tat_default", "tat_city", "tat_override")

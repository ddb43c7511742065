"""KPI block, scores and the per-account matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelsight.operators.common import with_whole
from parcelsight.functions.scalars import percent, ratio, rounded
from parcelsight.rules import shipments as S

#: Length of the intervals that gaps are counted in before the middle one is walked: 67 seconds.
INTERVAL_US = 1 << 26
_COUNTERS = ("n", "picked", "delivered", "first_attempt", "rto")
_DURATIONS = ("p2o", "p2d")


def _counter(name: str) -> Column:
    if name == "n":
        return F.lit(True)
    if name == "first_attempt":
        return F.col("delivered") & (F.col("attempts") == 1)
    if name == "rto":
        return F.col("outcome") == "RTO"
    return F.col(name)


def has_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose text keys are all filled."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(k), F.lit("")) != ""
                                                for k in keys])) if keys else df


def kpi_block(df: DataFrame, keys: list[str], carry: dict[str, str] | None = None) -> DataFrame:
    """Volume, success, first-attempt rate, exact median O2S and mean durations per key.

    Rows are first grouped by (keys, o2s) with map-side combining. The median is then found in two
    bounded walks over those counts: within each interval of ``INTERVAL_US``, so a key holding most
    rows, each with a gap of its own, is spread over many tasks, and over the intervals of each key,
    whose number the length of the gaps bounds. Both walks read the shuffle of the first grouping.
    Sums are whole numbers, so the result does not depend on order.
    """
    carry = carry or {}
    groups = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    names = keys or ["_all"]
    sums = [F.count_if(_counter(k)).alias(k) for k in _COUNTERS]
    for d in _DURATIONS:
        us = F.col(f"{d}_us")
        sums += [F.count(us).alias(f"{d}_n"),
                 F.sum(F.floor(us / 1000000).cast("bigint")).alias(f"{d}_s"),
                 F.sum(F.pmod(us, F.lit(1000000))).alias(f"{d}_u")]
    sums += [F.count("attempts").alias("att_n"), F.sum("attempts").alias("att_s")]
    sums += [F.min(src).alias(out) for out, src in carry.items()]
    interval = F.coalesce(F.floor(F.col("o2s_us") / INTERVAL_US).cast("bigint"), F.lit(-1))
    cells = has_key(df, keys).groupBy(*groups, interval.alias("_interval"), F.col("o2s_us")).agg(*sums)

    valued = F.when(F.col("o2s_us").isNotNull(), F.col("n"))
    place = [*names, "_interval"]
    inner = cells.withColumn("_within", F.sum(valued).over(Window.partitionBy(*place).orderBy("o2s_us")))
    # hashing every column keeps both readers of the cells alike, so they share one shuffle
    intervals = cells.groupBy(*place).agg(
        F.sum(valued).alias("_in"), F.max(F.xxhash64(*cells.columns)).alias("_same"))
    by_key = Window.partitionBy(*names)
    earlier = by_key.orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)
    walked = inner.join(intervals.select(
        *place, F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_in").over(by_key).alias("_all_n"), "_same"), place).withColumn(
        "_below", F.col("_before") + F.col("_within")).where(F.col("_same").isNotNull())
    low = F.min(F.when(F.col("_below") * 2 >= F.col("_all_n"), F.col("o2s_us")))
    high = F.min(F.when(F.col("_below") * 2 > F.col("_all_n"), F.col("o2s_us")))
    totals = [F.sum(k).alias(k) for k in _COUNTERS]
    means = [
        (F.try_divide(F.sum(f"{d}_s").cast("double") + F.sum(f"{d}_u").cast("double") / 1e6,
                      F.sum(f"{d}_n").cast("double")) / 3600.0).alias(d)
        for d in _DURATIONS
    ]
    out = walked.groupBy(*names).agg(
        *totals, ((low.cast("double") + high.cast("double")) / 7.2e9).alias("o2s"), *means,
        ratio(F.sum("att_s"), F.sum("att_n")).alias("avg_attempts"),
        *[F.min(c).alias(c) for c in carry])
    out = out.withColumns({
        "success_rate": percent(F.col("delivered"), F.col("picked")),
        "first_attempt_rate": percent(F.col("first_attempt"), F.col("delivered")),
        "rto_pct": percent(F.col("rto"), F.col("n")),
    })
    return out if keys else out.drop("_all")


def _bounds(eligible: Column) -> list[tuple[str, Column]]:
    out = []
    for m in S.SCORE_WEIGHTS:
        v = F.when(eligible, F.col(m))
        out += [(f"{m}_lo", F.min(v)), (f"{m}_hi", F.max(v)), (f"{m}_k", F.count(v))]
    return out


def attach_scores(df: DataFrame, min_n: int = 0, partition: list[str] | None = None) -> DataFrame:
    """0-100 efficiency score by min-max normalising five metrics over the eligible groups.

    Without ``partition`` the pool is the whole frame and its bounds come from one scalar
    subquery; with it, from a window per partition. Groups under ``min_n`` shipments stay
    unscored and out of the pool.
    """
    eligible = F.col("n") >= min_n
    if partition:
        w = Window.partitionBy(*partition)
        pooled = df.withColumn("_pool", F.struct(*[c.over(w).alias(k)
                                                   for k, c in _bounds(eligible)]))
    else:
        pooled = with_whole(df, **dict(_bounds(eligible))).withColumnRenamed("_whole", "_pool")
    subs = {}
    for m, (_, lower_better) in S.SCORE_WEIGHTS.items():
        lo, hi = F.col(f"_pool.{m}_lo"), F.col(f"_pool.{m}_hi")
        up = (F.col(m) - lo) / (hi - lo)
        scaled = (1.0 - up if lower_better else up) * 100.0
        subs[f"sub_{m}"] = F.when(
            eligible & F.col(m).isNotNull() & (F.col(f"_pool.{m}_k") >= 2),
            F.when(hi == lo, F.lit(100.0)).otherwise(scaled))
    scored = pooled.withColumns(subs)
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, (w, _) in S.SCORE_WEIGHTS.items():
        sub = F.col(f"sub_{m}")
        total = total + F.coalesce(sub * w, F.lit(0.0))
        weight = weight + F.when(sub.isNotNull(), F.lit(w)).otherwise(0.0)
    scored = scored.withColumn("score", rounded(F.when(weight > 0, total / weight), 1))
    return scored.withColumns({s: rounded(F.col(s), 1) for s in subs}).drop("_pool")


def round_metrics(df: DataFrame) -> DataFrame:
    """Display rounding of the KPI columns, after scoring."""
    one = ["success_rate", "first_attempt_rate", "o2s", "p2o", "p2d", "rto_pct"]
    cols = {c: rounded(F.col(c), 1) for c in one if c in df.columns}
    cols["avg_attempts"] = rounded(F.col("avg_attempts"), 2)
    return df.withColumns(cols)


def _scored(df: DataFrame, keys, min_n, carry=None) -> DataFrame:
    return round_metrics(attach_scores(kpi_block(df, keys, carry), min_n))


def by_carrier(df: DataFrame) -> DataFrame:
    return _scored(df, ["carrier"], 0)


def by_warehouse(df: DataFrame) -> DataFrame:
    return _scored(df, ["pickup_pin"], S.MIN_N["warehouse"],
                   {"warehouse": "warehouse", "city": "city"})


def by_destination(df: DataFrame) -> DataFrame:
    return _scored(df, ["drop_city"], S.MIN_N["destination"])


def by_lane(df: DataFrame) -> DataFrame:
    return _scored(df, ["lane"], S.MIN_N["lane"])


def by_warehouse_account(df: DataFrame) -> DataFrame:
    """KPI block per (warehouse, account), scored inside each warehouse, with volume share."""
    block = kpi_block(df, ["pickup_pin", "account"], {"warehouse": "warehouse", "city": "city"})
    scored = round_metrics(
        attach_scores(block, S.MIN_N["warehouse_account"], partition=["pickup_pin"]))
    total = F.sum("n").over(Window.partitionBy("pickup_pin"))
    return scored.withColumn("wh_total", total).withColumn(
        "wh_share", rounded(percent(F.col("n"), F.col("wh_total")), 1))


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    """Best score first, unscored last; volume and then the key break ties."""
    return df.orderBy(F.col("score").desc_nulls_last(), F.col("n").desc(),
                      *[F.col(t) for t in ties])


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_")


def status_matrix(df: DataFrame, key: str = "account") -> DataFrame:
    """Count and share of the four outcomes per key."""
    counts = [F.count_if(F.col("outcome") == o).alias(_slug(o)) for o in S.OUTCOMES]
    out = has_key(df, [key]).groupBy(key).agg(F.count("*").alias("n"), *counts)
    return out.withColumns({f"{_slug(o)}_pct": rounded(percent(F.col(_slug(o)), F.col("n")), 1)
                            for o in S.OUTCOMES})


def pendency_matrix(df: DataFrame, key: str = "account") -> DataFrame:
    """Sub-states of forward pendency per key, long form; empty states have no row."""
    pending = has_key(df.where(F.col("outcome") == "FWD Pendency"), [key])
    cells = pending.groupBy(key, "pendency_state").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return cells.withColumn("account_n", total).withColumn(
        "pct", rounded(percent(F.col("n"), F.col("account_n")), 1))


def _tat_counts() -> list[Column]:
    status = F.coalesce(F.col("tat_status"), F.lit("No rule"))
    margin_s = F.floor(F.col("tat_margin") * 3600).cast("bigint")
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("delivered")).alias("delivered"),
        F.count_if(status == "In TAT").alias("in_tat"),
        F.count_if(status == "Out of TAT").alias("out_tat"),
        F.count_if(status == "No rule").alias("no_rule"),
        F.count_if(status == "Pending").alias("pending"),
        F.count_if((status == "Out of TAT") & F.col("delivered")).alias("out_delivered"),
        F.count_if((status == "Out of TAT") & ~F.col("delivered")).alias("out_pending"),
        ratio(F.sum(margin_s), F.count(margin_s) * 3600).alias("avg_margin"),
    ]


def _tat_rates(df: DataFrame) -> DataFrame:
    judged = F.col("in_tat") + F.col("out_tat")
    return df.withColumns({
        "evaluable": judged,
        "in_tat_pct": rounded(percent(F.col("in_tat"), judged), 1),
        "out_tat_pct": rounded(percent(F.col("out_tat"), judged), 1),
        "coverage_pct": rounded(percent(judged + F.col("pending"), F.col("n")), 1),
        "avg_margin": rounded(F.col("avg_margin"), 1),
    })


def tat_matrix(df: DataFrame, key: str = "account") -> DataFrame:
    """SLA compliance per account or warehouse."""
    return _tat_rates(has_key(df, [key]).groupBy(key).agg(*_tat_counts()))


def tat_summary(df: DataFrame) -> DataFrame:
    """SLA compliance of the whole slice, late deliveries apart from pending breaches."""
    return _tat_rates(df.agg(*_tat_counts()))

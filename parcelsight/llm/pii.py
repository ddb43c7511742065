"""Personal data: fixed formats, and identifiers found from the contexts in which those stand.

Bootstrapping with DataFrame functions only. Matches of the formats are seed entities. The words
around them are patterns; a pattern's confidence is the lower bound of the share of known entities
among the identifiers it stands next to. Identifiers next to trusted patterns become known
entities themselves, and the next round scores patterns again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelsight.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "context")

# Quantifiers are possessive where what follows can't match inside the run, so that long runs
# neither backtrack nor nest; a match may begin only at a run's start or where the last one ended.
_ADDRESS = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_ADDRESS}])|\G)[{_ADDRESS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # any other token with a digit is a candidate for the context patterns
    "context": r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+@-]*+[0-9][A-Za-z0-9._%+@-]*+",
}
#: A text without these can't match.
NEEDS = {
    "email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]", "context": "[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Rounds of bootstrapping, the least confidence of a trusted pattern (the lower end of Wilson's
#: 95 % interval), and the least combined confidence of an accepted identifier.
ROUNDS, TRUST, ACCEPT = 3, 0.9, 0.95
#: Characters to either side in which context words are looked for.
WINDOW = 64


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, place in order, characters before it, match, left and right context)."""
    pattern = PATTERNS[kind]
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), pieces.alias("left"),
        F.slice(pieces, 2, 2**31 - 1).alias("right"))
    found = F.transform(zipped, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"),
        F.length(x["match"]).alias("size"), F.length(x["left"]).alias("before"), x["match"].alias("match"),
        F.right(x["left"], F.lit(WINDOW)).alias("left"), F.left(x["right"], F.lit(WINDOW)).alias("right")))
    return F.when(text.rlike(NEEDS[kind]), F.filter(found, lambda x: x["match"].isNotNull()))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    return (
        F.when(kind == 1, match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == 2, F.length(digits).between(14, 19) & _luhn(digits))
        .when(kind == 3, F.length(digits).between(10, 15)).otherwise(True))


def _placed(found: DataFrame) -> DataFrame:
    """Valid matches with start and end; candidates that touch a base match are left out."""
    order = W.partitionBy("row", "kind").orderBy("place")
    before = F.sum("before").over(order) + F.coalesce(
        F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = (
        found.withColumn("start", before).withColumn("end", F.col("start") + F.col("size"))
        .where(_valid(F.col("kind"), F.col("match"))))
    # The furthest end of the base matches that begin before, and the next one that begins after.
    by_start = W.partitionBy("row").orderBy("start")
    base = lambda c: F.when(F.col("kind") < 4, F.col(c))
    past = F.max(base("end")).over(by_start.rangeBetween(W.unboundedPreceding, 0))
    ahead = F.min(base("start")).over(by_start.rangeBetween(0, W.unboundedFollowing))
    return (
        spans.withColumn("past", past).withColumn("ahead", ahead)
        .where((F.col("kind") < 4) | (
            (F.coalesce("past", F.lit(-1)) <= F.col("start"))
            & (F.coalesce("ahead", F.col("end")) >= F.col("end"))))
        .select("row", "kind", "start", "end", F.lower("match").alias("entity"), "left", "right"))


def _with_patterns(spans: DataFrame) -> DataFrame:
    """Each span with its lexical patterns: the word before, the two before, the word after."""
    clean = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    left, right = F.split(clean("left"), " "), F.split(clean("right"), " ")
    word = lambda words, k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit(""))
    named = lambda side, c: F.when(c != "", F.concat(F.lit(side), c))
    one, two = word(left, -1), word(left, -2)
    return spans.withColumn("patterns", F.array_compact(F.array(
        named("before ", one), F.when(two != "", F.concat(F.lit("before "), two, F.lit(" "), one)),
        named("after ", word(right, 1))))).drop("left", "right")


def _bootstrap(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns with their confidence, entities known after the last round)."""
    graph = written(
        spans.select("entity", F.explode("patterns").alias("pattern")).distinct(), "graph")
    known = written(spans.where("kind < 4").select("entity").distinct(), "known")
    for k in range(ROUNDS):
        flagged = graph.join(known.withColumn("known", F.lit(1)), "entity", "left")
        n, share = F.col("n"), F.col("hits") / F.col("n")
        z = 1.96
        bound = (share + z * z / (2 * n)
                 - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        trusted = written(
            flagged.groupBy("pattern").agg(F.count("*").alias("n"), F.count("known").alias("hits"))
            .withColumn("confidence", bound).where(F.col("confidence") >= TRUST)
            .select("pattern", "confidence"), "trusted")
        if k == ROUNDS - 1:
            break
        doubt = F.sum(F.log(1 - F.col("confidence") + F.lit(1e-9)))
        found = (graph.join(trusted, "pattern").groupBy("entity").agg(doubt.alias("doubt"))
                 .where(F.exp("doubt") <= 1 - ACCEPT).select("entity"))
        known = written(known.union(found).distinct(), "known")
    return trusted, known


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``.

    Spans are kind:start:end in code points, by start and kind, joined by commas; those of kind
    ``context`` come from trusted patterns. Null and empty texts have none, and repeated rows are
    scanned each. Further columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("array()")
    scanned = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.concat(*[F.coalesce(_matches(body, k), none) for k in KINDS]).alias("found")), "scanned")
    spans = written(_with_patterns(_placed(
        scanned.select("row", F.inline("found")))), "spans")

    trusted, _ = _bootstrap(spans)
    doubt = F.exp(F.sum(F.log(1 - F.col("confidence") + F.lit(1e-9))))
    place = ["row", "kind", "start", "end"]
    more = (
        spans.where("kind = 4").select(*place, F.explode("patterns").alias("pattern"))
        .join(trusted, "pattern").groupBy(*place).agg(doubt.alias("doubt"))
        .where(F.col("doubt") <= 1 - ACCEPT).select(*place))
    every = spans.where("kind < 4").select(*place).union(more)
    names = F.array(*map(F.lit, KINDS))
    listed = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
        x["end"].cast("string"))))
    by_row = every.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    found = scanned.select("row", "doc_id").join(by_row, "row", "left").withColumn(
        "s", F.coalesce("s", empty))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listed(F.filter("s", lambda x: x["kind"] < 4)).cast("binary"), 256)
        .alias("base_sha256"), listed(F.col("s")).alias("spans"))

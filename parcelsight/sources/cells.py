"""Delimited files as rows of text cells, and header rows resolved per file."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from parcelsight.functions.scalars import norm_header, to_number
from parcelsight.session import cut_lineage

HEAD_ROWS = 15
#: What cells may be parted by; of equal claims the earlier one holds.
SEPARATORS = (",", "\t", ";", "|")
#: Names of delimited files; those that end in gz are unpacked by the readers and never split.
EXTENSIONS = "*.{csv,tsv,CSV,TSV,csv.gz,tsv.gz,CSV.gz,TSV.gz}"


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length, modified) of all delimited files under ``path`` that hold any bytes; none is
    opened."""
    return spark.read.format("binaryFile").options(
        recursiveFileLookup=True, pathGlobFilter=EXTENSIONS).load(path).select(
        F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _literal(file: str) -> str:
    """A path whose characters a reader takes as they are and not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", file)


def _plain(uri: Column) -> Column:
    """A file's path as listings give it, from the form of ``_metadata.file_path``."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _shapes(lines: DataFrame, *facts: Column) -> DataFrame:
    """(uri, _k0.., lines, ...): lines counted by file and by how often ``bare`` holds each separator.

    ``bare`` is a line without what is quoted. Lines of one shape are counted before they are shuffled.
    """
    held = [(F.length("bare") - F.length(F.replace("bare", F.lit(s)))).alias(f"_k{i}")
            for i, s in enumerate(SEPARATORS)]
    return lines.withColumns({c: h for c, h in zip(_COUNTS, held)}).groupBy("uri", *_COUNTS).agg(
        F.count("*").alias("lines"), *facts)


_COUNTS = [f"_k{i}" for i in range(len(SEPARATORS))]


def _separators(shapes: DataFrame) -> DataFrame:
    """(uri, at, alike, most): the separator of each file by the ``_shapes`` of its lines.

    It is the one that most lines hold equally often, at least once. ``alike`` of 0 means that there
    is none; ``most`` is how often a line holds it at most.
    """
    per_count = shapes.select("uri", "lines", F.posexplode(F.array(*_COUNTS)).alias("at", "k")).groupBy(
        "uri", "at", "k").agg(F.sum("lines").alias("lines"))
    per_separator = per_count.groupBy("uri", "at").agg(
        F.coalesce(F.max(F.when(F.col("k") > 0, F.col("lines"))), F.lit(0)).alias("alike"),
        F.max("k").alias("most"))
    best = F.max_by(F.struct("at", "alike", "most"), F.struct("alike", "most", -F.col("at")))
    return per_separator.groupBy("uri").agg(best.alias("b")).select("uri", "b.*")


def file_dialects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, sep, encoding, multiline, width, markup): how each file that isn't empty is written.

    One pass over the lines. The separator is the one that most lines hold equally often; a file
    without any goes by its name. Bytes that aren't UTF-8 make a file Latin-1. A line with an odd
    number of quotes means that cells hold line breaks: such files, which can't be split, are
    measured on their whole text without what is quoted.
    """
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=EXTENSIONS).text(path).select(
        F.col("_metadata.file_path").alias("uri"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")
    ).where(F.trim("value") != "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    quoted = F.contains("value", F.lit('"'))
    markup = F.startswith(F.ltrim("value"), F.lit("<"))
    shapes = cut_lineage(_shapes(
        lines.withColumn("bare", F.when(quoted, bare).otherwise(F.col("value"))),
        F.every(F.is_valid_utf8("value")).alias("utf8"), F.max(quotes % 2 == 1).alias("multiline"),
        F.min(F.struct("place", markup.alias("markup"))).alias("top")), "shapes")
    facts = shapes.groupBy("uri").agg(
        F.every("utf8").alias("utf8"), F.max("multiline").alias("multiline"),
        F.min("top")["markup"].alias("markup"))
    found = _separators(shapes)
    broken = [r["file"] for r in facts.where("multiline").select(
        _plain(F.col("uri")).alias("file")).collect()]  # a path each
    if broken:
        rows = spark.read.text([_literal(f) for f in broken], wholetext=True).select(
            F.col("_metadata.file_path").alias("uri"),
            F.explode(F.split(bare, "\r\n|\r|\n")).alias("bare")).where(F.trim("bare") != "")
        found = found.join(facts.where("multiline"), "uri", "left_anti").unionByName(
            _separators(_shapes(rows)))
    by_name = F.when(F.lower("uri").rlike(r"\.tsv(\.gz)?$"), F.lit("\t")).otherwise(",")
    return cut_lineage(facts.join(found, "uri").select(
        _plain(F.col("uri")).alias("file"),
        F.when(F.col("alike") > 0, F.get(F.array(*map(F.lit, SEPARATORS)), F.col("at")))
        .otherwise(by_name).alias("sep"),
        F.when(F.col("utf8"), F.lit("UTF-8")).otherwise("ISO-8859-1").alias("encoding"),
        "multiline", (F.col("most") + 1).alias("width"), "markup"), "dialects")


def _groups(dialects: DataFrame) -> list[Row]:
    """The files of each dialect, wide files apart from narrow ones.

    The driver holds the list of files, as the reader does. Files that begin like a page of markup
    are left out (`file_problems` lists them).
    """
    plain = dialects.where(~F.col("markup")).withColumn(
        "columns", F.pow(F.lit(2), F.ceil(F.log2(F.col("width")))).cast("int"))
    return plain.groupBy("sep", "encoding", "multiline", "columns").agg(
        F.sort_array(F.collect_list("file")).alias("files")).orderBy(
        "sep", "encoding", "multiline", "columns").collect()


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All delimited files under ``path`` as (path, row_no, cells), each in its own dialect.

    Files of one dialect are one read; every cell of every row is kept. ``row_no`` counts the rows
    of a file's first split from zero and is null further down: headers are only looked for near
    the top, and nothing else depends on row order.
    """
    numbered = [_read(spark, g) for g in _groups(file_dialects(spark, path))]
    if not numbered:
        return spark.createDataFrame([], "path string, row_no bigint, cells array<string>")
    return _numbered(reduce(DataFrame.unionByName, numbered))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of `_read` with ``row_no``. What is broadcast is a number for each file of the driver's
    list; rows aren't shuffled to meet it, whatever the size of one file."""
    first = F.broadcast(rows.where(F.col("_start") == 0).groupBy("path").agg(
        F.min("_seq").alias("_first")))
    row_no = F.when(F.col("_start") == 0, F.col("_seq") - F.col("_first")).alias("row_no")
    kept = [c for c in rows.columns if c not in ("path", "_start", "_seq")]
    return rows.join(first, "path", "left").select("path", row_no, *kept)


def _columns(group: Row) -> list[str]:
    return [f"c{i}" for i in range(group["columns"])]


def _options(group: Row) -> dict[str, str]:
    return {"sep": group["sep"], "escape": '"', "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "true", "maxColumns": str(group["columns"] + 1),
            "maxCharsPerColumn": "-1"}


def _read(spark: SparkSession, group: Row, files: list[str] | None = None,
          fields: list[Column] | None = None) -> DataFrame:
    """Files of one dialect; only the columns that ``fields`` name are parsed into cells."""
    rows = spark.read.schema(_schema(group)).options(
        encoding=group["encoding"], multiLine=group["multiline"], header=False, **_options(group)).csv(
        [_literal(f) for f in files or group["files"]])
    return _placed(rows, *(fields or [F.array(*_columns(group)).alias("cells")]))


def _schema(group: Row) -> str:
    return ", ".join(f"{n} string" for n in _columns(group))


def _placed(rows: DataFrame, *fields: Column) -> DataFrame:
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"), *fields)


#: Parts no text: with it the reader gives a line whole.
_NO_SEPARATOR = "\u0001"


def _headers(spark: SparkSession, group: Row) -> DataFrame:
    """(path, header): the first row of each file of one dialect.

    Lines that are rows are taken whole and only the first of them are parted into cells. The
    headers, a row a file, are written out: what looks for names in them repeats no parsing.
    """
    if group["multiline"]:
        return cut_lineage(first_rows(_numbered(_read(spark, group))), "headers")
    whole = spark.read.schema("line string").options(
        sep=_NO_SEPARATOR, quote="", encoding=group["encoding"], header=False,
        maxCharsPerColumn=-1).csv([_literal(f) for f in group["files"]])
    top = _numbered(_placed(whole, F.col("line"))).where(F.col("row_no") == 0)
    parsed = F.array(F.from_csv("line", F.lit(_schema(group)), _options(group)))
    cells = F.transform(parsed, lambda c: F.array(*[c[n] for n in _columns(group)]))
    return cut_lineage(first_rows(top.select("path", "row_no", cells[0].alias("cells"))), "headers")


def _wanted(fields: dict[str, list[str]]) -> dict[str, list[str]]:
    return {k: [h.strip().lower() for h in names] for k, names in fields.items()}


def read_fields(spark: SparkSession, path: str | list[str], fields: dict[str, list[str]],
                required: list[str]) -> DataFrame:
    """`select_fields` of all delimited files under ``path``, reading no other columns.

    Headers are resolved once per file; files of one dialect that hold the fields at the same
    places are one read of just those columns.
    """
    groups, wanted = _groups(file_dialects(spark, path)), _wanted(fields)
    found = [_headers(spark, g).select(
        F.lit(k).alias("at"), _plain(F.col("path")).alias("file"),
        F.struct(*[position(F.col("header"), names).alias(f) for f, names in wanted.items()]).alias("p"))
        for k, g in enumerate(groups)]
    if not found:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("path", *wanted)))
    placed = reduce(DataFrame.unionByName, found)
    for k in required:
        placed = placed.where(F.col(f"p.{k}").isNotNull())
    layouts = placed.groupBy("at", "p").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(
        "at", "p").collect()
    reads = [_read(spark, groups[l["at"]], l["files"], [
        (F.lit(None).cast("string") if l["p"][f] is None else F.col(f"c{l['p'][f]}")).alias(f)
        for f in wanted]) for l in layouts]
    if not reads:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("path", *wanted)))
    rows = _numbered(reduce(DataFrame.unionByName, reads))
    return rows.where(F.coalesce("row_no", F.lit(1)) > 0).select("path", *wanted)


def folder_of(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.url_decode(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))


def file_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, "([^/]*)$", 1))


def norm_cells(cells: Column) -> Column:
    return F.transform(cells, norm_header)


def position(header: Column, names: list[str]) -> Column:
    """Zero-based index of the first candidate present in a header array, else null."""
    found = [F.when(F.array_contains(header, n), F.array_position(header, n) - 1) for n in names]
    return F.coalesce(*found).cast("int")


def cell(index: str) -> Column:
    return F.get("cells", F.col(index))


def first_rows(cells: DataFrame) -> DataFrame:
    """The header of files that start with it: one row per file."""
    return cells.where(F.col("row_no") == 0).select("path", norm_cells(F.col("cells")).alias("header"))


def select_fields(cells: DataFrame, fields: dict[str, list[str]],
                  required: list[str]) -> DataFrame:
    """Logical columns by header name, whatever the column order of each file.

    The header rows, one per file, become positions and meet the data rows in a join that AQE
    turns into a broadcast when they are small and splits when one file dominates. Files that
    lack a required column are left out; `file_problems` lists them.
    """
    wanted = _wanted(fields)
    heads = first_rows(cells).select("path", *[position(F.col("header"), names).alias(f"_{k}")
                                               for k, names in wanted.items()])
    for k in required:
        heads = heads.where(F.col(f"_{k}").isNotNull())
    body = cells.where(F.coalesce("row_no", F.lit(1)) > 0)
    return body.join(heads, "path").select("path", *[cell(f"_{k}").alias(k) for k in wanted])


def file_problems(spark: SparkSession, path: str | list[str], fields: dict[str, list[str]],
                  required: list[str]) -> DataFrame:
    """(file, problem) of every file under ``path`` that gives no rows, and why.

    Files of no bytes at all aren't listed: Spark's readers leave them out.
    """
    dialects = file_dialects(spark, path)
    heads = reduce(DataFrame.unionByName, [
        _headers(spark, g) for g in _groups(dialects)] or [
        spark.createDataFrame([], "path string, header array<string>")]).withColumn(
        "file", _plain(F.col("path")))
    missing = [F.when(position(F.col("header"), [h.strip().lower() for h in fields[k]]).isNull(),
                      F.lit(k)) for k in required]
    lacking = heads.select("file", F.array_join(F.array_compact(F.array(*missing)), ", ").alias("lacks"))
    known = list_files(spark, path).join(dialects.select("file", "markup"), "file", "left").join(
        lacking, "file", "left")
    problem = (F.when(F.col("markup").isNull(), F.lit("no rows"))
               .when(F.col("markup"), F.lit("looks like HTML or XML"))
               .when(F.col("lacks") != "", F.concat(F.lit("missing required column(s): "), "lacks")))
    return known.select("file", problem.alias("problem")).where(F.col("problem").isNotNull())


def column_profile(cells: DataFrame, keywords: dict[str, list[str]], samples: int = 3) -> DataFrame:
    """Columns of each file: header name, fill count, a few samples and a suggested field.

    The header is the fullest of the first rows. Samples are the first filled values of a column,
    however far down they are: those of numbered rows in their order, then the others by value.
    """
    filled = F.size(F.filter("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    head = cells.where(F.col("row_no") < HEAD_ROWS).groupBy("path").agg(
        F.min(F.struct(-filled, "row_no", "cells")).alias("h")).select(
        "path", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("header"))
    body = cells.join(head.select("path", "header_row"), "path").where(
        F.coalesce("row_no", F.lit(1 << 40)) > F.col("header_row"))
    values = body.select("path", "row_no", F.posexplode("cells").alias("pos", "value")).where(
        F.coalesce("value", F.lit("")) != "")
    counts = values.groupBy("path", "pos").agg(F.count("*").alias("filled"))
    # each task passes on no more than the first few values of a column
    order = Window.partitionBy("path", "pos").orderBy(F.col("row_no").asc_nulls_last(), "value")
    early = values.withColumn("_nth", F.row_number().over(order)).where(
        F.col("_nth") <= samples).groupBy("path", "pos").agg(
        F.sort_array(F.collect_list(F.struct("_nth", "value"))).alias("s"))
    columns = head.select("path", "header_row", F.posexplode("header").alias("pos", "name")) \
        .where(F.coalesce("name", F.lit("")) != "")
    out = columns.join(counts, ["path", "pos"], "left").join(early, ["path", "pos"], "left")
    return out.select("path", "header_row", "pos", "name", F.coalesce("filled", F.lit(0)).alias("filled"),
                      F.array_join("s.value", " | ").alias("samples"),
                      F.array_join(_suggested(norm_header(F.col("name")), keywords), ", ")
                      .alias("suggested"))


def _suggested(header: Column, keywords: dict[str, list[str]]) -> Column:
    """Fields whose keywords equal the header, else those with a keyword inside it."""
    exact = F.array_compact(F.array(*[F.when(header.isin(k), F.lit(f)) for f, k in keywords.items()]))
    loose = F.array_compact(F.array(*[
        F.when(F.exists(F.array(*[F.lit(k) for k in words]), lambda w: F.contains(header, w)), F.lit(f))
        for f, words in keywords.items()]))
    return F.when(F.size(exact) > 0, exact).otherwise(loose)


def number_cell(index: str) -> Column:
    return to_number(cell(index))

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes. Stages whose fused method would be
    # larger run as separate, compiled operators instead of being interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("parcelsight")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint location.

    The location is the one the session names in ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="parcelsight-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = shared_folder(df.sparkSession, label)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


_RULE_TABLES: WeakKeyDictionary = WeakKeyDictionary()


def rule_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of fixed values as a local relation (its size is known to Catalyst).

    ``columns`` is a DDL list such as ``"pin string, tat double"``. The plan is kept per
    session, so a table is parsed once.
    """
    tables = _RULE_TABLES.setdefault(spark, {})
    key = (columns, tuple(rows))
    if key not in tables:
        tables[key] = _values(spark, columns, rows)
    return tables[key]


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    names = [c.split()[0] for c in columns.split(",")]
    casts = ", ".join(
        f"CAST({n} AS {c.split()[1]}) AS {n}" for n, c in zip(names, columns.split(","))
    )
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")

"""Query registry: a name, a Spark callable and, where SQL can say it, a check statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.fixtures import AS_OF, Fixtures
from parcelsight.operators import invoices as I
from parcelsight.operators import lookups as L
from parcelsight.operators import shipments as SH
from parcelsight.operators import sla
from parcelsight.session import cut_lineage
from parcelsight.sources.invoices import file_months

CATALOG: dict[str, tuple[Callable, str | None]] = {}


class Inputs:
    """The inputs queries start from: plans only, built on first use and never cached as data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.fx = Fixtures(spark, folder)

    def settled(self) -> Inputs:
        """The same inputs over the joined rows of shipments, written to the shared folder for the run
        of a query that reads them several times: the joins are not repeated for every reading."""
        return self._settled

    @cached_property
    def _settled(self) -> Inputs:
        out = Inputs(self.spark, self.fx.folder)
        out.fx.shipments_joined = cut_lineage(self.fx.shipments_joined, "shipments", compression="zstd")
        return out

    def unsettled(self) -> Inputs:
        """These inputs before anything was written: no run reads what another one wrote."""
        self.__dict__.pop("_settled", None)
        return self

    @cached_property
    def raw(self) -> DataFrame:
        return self.fx.shipments_raw

    @cached_property
    def facts(self) -> DataFrame:
        return SH.shipment_facts(self.raw, AS_OF)

    @cached_property
    def ships(self) -> DataFrame:
        return SH.build_shipments(self.raw, AS_OF)

    @cached_property
    def overrides(self) -> DataFrame:
        return sla.clean_overrides(self.fx.sla_overrides_raw)

    @cached_property
    def classified(self) -> DataFrame:
        return sla.classify_sla(self.ships, self.fx.sla_lanes, self.overrides)

    @cached_property
    def master(self) -> DataFrame:
        return L.read_master(self.fx.item_master_raw)

    @cached_property
    def lines(self) -> DataFrame:
        """Invoice lines with their billing month."""
        raw = self.fx.invoice_raw
        dated = raw.join(file_months(raw), "path", "left")
        return I.tag_period(dated, F.col("file_month"), F.col("file_label")).drop(
            "path", "file_month", "file_label")

    @cached_property
    def sku_lines(self) -> DataFrame:
        """Invoice lines with the SKU of ``enriched`` and nothing else of it, without months."""
        lines = self.fx.invoice_raw.drop("path")
        billed = L.likely_billed(self.raw, L.without_sku(lines))
        return L.settle_skus(lines, self.master, tuple(SH.shipment_facts(s, AS_OF) for s in billed))

    @cached_property
    def enriched(self) -> DataFrame:
        return L.attach_shipments(L.enrich_from_master(self.lines, self.master), self.facts)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)`` under a name, with the statement it is checked against."""
    def wrap(fn):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = (fn, sql)
        return fn
    return wrap


_INPUTS: WeakKeyDictionary = WeakKeyDictionary()


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    known = _INPUTS.setdefault(spark, {})
    if folder not in known:
        known[folder] = Inputs(spark, folder)
    return CATALOG[name][0](known[folder].unsettled())

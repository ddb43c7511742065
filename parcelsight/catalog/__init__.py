"""Registered queries and their check statements."""

from parcelsight.catalog.registry import CATALOG


def load() -> dict:
    from parcelsight.catalog import ingest_queries, invoice_queries, shipment_queries  # noqa: F401
    return CATALOG

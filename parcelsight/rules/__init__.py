"""Lookup tables, keyword lists and thresholds. No logic lives here."""

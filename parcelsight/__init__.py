"""Parcel-logistics analytics as Spark DataFrame plans."""

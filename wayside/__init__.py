"""Incident analytics on Spark: ingestion, cleaning, features, reports, quality, layout."""

from wayside.model import INCIDENT, Roles

__all__ = ["INCIDENT", "Roles"]

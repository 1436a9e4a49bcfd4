"""The registered queries."""

from dataquay.plans import anonymity, changes, inference, keys, listing, models, profiling, scans, stored, streams
from dataquay.plans.registry import QUERIES, Tables

__all__ = [
    "QUERIES", "Tables", "anonymity", "changes", "inference", "keys", "listing", "models", "profiling", "scans", "stored", "streams",
]

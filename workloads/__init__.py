"""Registered queries over the given tables, each with the SQL another engine checks it against."""

from workloads.registry import ORACLES, QUERIES  # noqa: F401
from workloads import corpus, labelling, metrics, reports, robustness, text, models, proofs, streams  # noqa: F401,E402

"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

from prlens.plans import (  # noqa: F401
    changes, findings, history, intake, manifests, report, retrieval, reviews, streams,
)
from prlens.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "flagship"]


def flagship(spark, sf_dir):
    """The per-PR risk report."""
    return QUERIES["pr_risk_report"](spark, sf_dir)

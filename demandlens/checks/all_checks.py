"""Importing this module fills the registry."""

from demandlens.checks import cadence_checks, explore_checks, lead_checks, phrase_checks, plan_checks, site_checks, source_checks, stream_checks  # noqa: F401
from demandlens.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

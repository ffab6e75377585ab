"""Search-demand and lead-pipeline analytics as Spark DataFrame operators."""

from demandlens.settings import Settings

__all__ = ["Settings"]

"""Hire-revenue and finance-control analytics on Spark DataFrames."""

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.sources.catalog import Catalog

__all__ = ["Catalog", "DEFAULT_RULES", "Rules"]

"""Metadata and lineage facts for a whole table of SQL statements, as DataFrames."""

from sqltrail.plans.analysis import Analysis

__all__ = ["Analysis"]

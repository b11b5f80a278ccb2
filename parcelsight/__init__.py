"""Delivery monitoring on Spark: every operator takes DataFrames and returns DataFrames."""

from parcelsight.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]

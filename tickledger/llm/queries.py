"""Importing this module registers the queries of the corpus operators."""

from . import decontaminate, html_extract, line_dedup, mixing, near_dup, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts, tokenizer_alignment, url_filter  # noqa: F401
from .common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

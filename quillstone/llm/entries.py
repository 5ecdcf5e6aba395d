"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fmindex, fst, langid, lm, minhash, packing, quality, rans, warc, winnow

MODULES = [fst, rans, fmindex, warc, minhash, winnow, langid, quality, packing, lm]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}

"""Digest, rank and key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY_KEYS = ("file_sha256", "rgb_sha256", "input_sha256")
SIGNATURES = ("ahash", "dhash", "phash")
MATCH_METHODS = ("file_sha256", "rgb_sha256", "ahash", "dhash", "phash", "hash_consensus")


def digest(column: Column | str) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def stable_rank(seed: int, sample_id: Column | str, purpose: str | None = None) -> Column:
    """Hex digest of ``seed NUL [purpose NUL] id``: an input-order-free shuffle key."""
    prefix = f"{seed}\0" if purpose is None else f"{seed}\0{purpose}\0"
    return F.sha2(F.concat(F.lit(prefix), sample_id), 256)


def order_key(rank: Column, sample_id: Column | str) -> Column:
    """One string that sorts like the pair (rank, id); ranks have equal length."""
    return F.concat(rank, F.lit(" "), sample_id)


def key_id(order: Column) -> Column:
    """The id part of an ``order_key``."""
    return F.expr("substring(" + order + ", 66)") if isinstance(order, str) else order.substr(
        F.lit(66), F.length(order)
    )


def group_id(rule: str, value: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{rule}\0"), value), 256)


def consensus(ahash: str = "ahash", dhash: str = "dhash", phash: str = "phash") -> Column:
    return F.concat_ws(":", ahash, dhash, phash)


def rule_key(rule: str) -> Column:
    """The grouping column a deduplication rule stands for."""
    if rule == "exact_input":
        return F.col("input_sha256")
    if rule == "hash_consensus":
        return consensus()
    raise ValueError(f"Unknown deduplication rule: {rule}")


def hash_mask(left: str, right: str) -> Column:
    """Which signatures agree between two aliased rows: 1 ahash, 2 dhash, 4 phash."""
    bits = [
        (F.col(f"{left}.{name}") == F.col(f"{right}.{name}")).cast("int") * (1 << place)
        for place, name in enumerate(SIGNATURES)
    ]
    return bits[0] + bits[1] + bits[2]


def unsafe_path(path: Column | str) -> Column:
    """True for an absolute path or one that climbs out of its root."""
    column = F.col(path) if isinstance(path, str) else path
    return column.rlike(r"^/") | column.rlike(r"(^|/)\.\.(/|$)")

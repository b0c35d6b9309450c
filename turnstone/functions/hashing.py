"""Content fingerprints and deterministic ids."""

from __future__ import annotations

import hashlib
import json
from enum import Enum
from pathlib import PurePath

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import col, single_spaced

# Settings that do not change what a run computes.
VOLATILE = ("output_dir", "workers", "verbose", "quiet", "dry_run", "resume", "force", "retry_failed")


def sha256(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def canonical_text(c: str | Column) -> Column:
    """Lower case, outer white space cut, inner white space as one blank."""
    return single_spaced(F.lower(col(c)))


def xxh64(c: str | Column, seed: int = 0) -> Column:
    """64-bit xxHash as 16 hex digits; the built-in function fixes another seed, the expression itself takes any.

    Where the session gives no access to the expression (a remote client), Arrow batches do the same.
    """
    try:
        jvm = SparkContext._active_spark_context._jvm
        bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
        seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq([bridge.expression(col(c)._jc)])
        hashed = Column(bridge.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, seed)))
    except (AttributeError, TypeError):
        return _xxh64_batches(seed)(col(c))
    return F.when(col(c).isNotNull(), F.lpad(F.lower(F.hex(hashed)), 16, "0"))


def _xxh64_batches(seed: int):
    @F.arrow_udf("string")
    def digest(texts: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([None if t is None else xxhash.xxh64_hexdigest(t, seed=seed) for t in texts.to_pylist()], pa.string())

    return digest


def normalized_hash(c: str | Column) -> Column:
    return xxh64(canonical_text(c))


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """An id that is the same in every run: the prefix and twelve digits of the parts' SHA-256."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.left(F.sha2(joined, 256), F.lit(12)))


def file_id(path: str | Column, size: str | Column, content: str | Column) -> Column:
    """Stem (30 characters, other signs as _) and eight digits of the hash of path, size and the first 16 KiB."""
    stem = F.regexp_extract(col(path), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    digest = F.sha2(F.concat(F.encode(col(path), "UTF-8"), F.encode(col(size).cast("string"), "UTF-8"), F.substring(col(content), 1, 16384)), 256)
    return F.concat(F.left(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), F.lit(30)), F.lit("_"), F.left(digest, F.lit(8)))


def canonical_config(config: dict, volatile: tuple[str, ...] = VOLATILE) -> str:
    """Sorted compact JSON of a run's settings, without those that do not change its results."""

    def plain(x):
        if isinstance(x, Enum):
            return x.value
        if isinstance(x, PurePath):
            return x.as_posix()
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple, set)) else x

    kept = {k: plain(v) for k, v in config.items() if k not in volatile}
    return json.dumps(kept, sort_keys=True, separators=(",", ":"))


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical_config(config).encode()).hexdigest()


def idempotency_key(**parts: str | Column) -> Column:
    """SHA-256 of the compact JSON of the named parts in alphabetical order."""
    fields = [F.coalesce(col(parts[k]).cast("string"), F.lit("")).alias(k) for k in sorted(parts)]
    return F.sha2(F.to_json(F.struct(*fields)), 256)

"""Versioned sets of tables under a manifest: written whole beside the last version, committed by one rename, never over what can't be read.

A manifest names each table's folder, codec, row count and checksum. A reader takes the newest manifest; it refuses a damaged
manifest, a table whose rows don't have its checksum, and a codec newer than it knows, and lifts older ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT = 1


class Unreadable(ValueError):
    """The stored version is damaged, incomplete or of a newer format."""


class Conflict(ValueError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Codec:
    """The schema of a kind of table in its newest version, and how rows of each older version become the next one's."""

    version: int
    schema: str
    lifts: dict[int, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


#: The kinds of documents that are kept.
CODECS: dict[str, Codec] = {
    "state": Codec(2, "cluster string, total_drops bigint, tx_count bigint, first_seen bigint, last_seen bigint, role_rank bigint, severity_rank bigint, members array<string>", {1: lambda df: df.withColumn("members", F.array().cast("array<string>"))}),
    "archive": Codec(1, "cluster string, archived_at bigint, total_drops bigint, tx_count bigint, last_seen bigint, severity_rank bigint"),
    "window": Codec(1, "ledger bigint, close_ms bigint, tx_count bigint, malicious bigint, suspect bigint"),
    "history": Codec(1, "cluster string, members array<string>, label string, total_drops bigint, tx_count bigint, first_seen bigint, last_seen bigint, rules array<string>, sightings bigint"),
    "entity": Codec(1, "entity string, members array<string>, signal double, fingerprint string"),
    "jobs": Codec(1, "job string, from_ledger bigint, to_ledger bigint, status string, updated_ms bigint"),
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest; None where nothing was ever committed."""
    known = versions(spark, root)
    if not known:
        return None
    try:
        m = json.loads(_read(spark, f"{root}/manifest-{known[-1]:010}.json"))
        tables = m["tables"]
        fine = m["version"] == known[-1] and all({"kind", "codec", "folder", "rows", "checksum"} <= set(t) for t in tables.values())
    except (ValueError, KeyError, TypeError, AttributeError) as broken:
        raise Unreadable(f"{root}: the manifest of version {known[-1]} is damaged") from broken
    if m.get("format", 0) > FORMAT:
        raise Unreadable(f"{root}: manifest format {m['format']} is newer than {FORMAT}")
    if not fine:
        raise Unreadable(f"{root}: the manifest of version {known[-1]} is incomplete")
    return m


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, sum and xor of the rows' hashes): the same in any order and layout; repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r.n, f"{r.s}:{r.x}"


def load(spark: SparkSession, root: str, name: str, verify: bool = True) -> DataFrame:
    """A table of the newest version, lifted to its codec's newest schema. verify reads it once to hold it against its checksum."""
    m = manifest(spark, root)
    if m is None or name not in m["tables"]:
        raise Unreadable(f"{root}: no table {name}")
    t, codec = m["tables"][name], CODECS.get(m["tables"][name]["kind"])
    if codec is None or t["codec"] > codec.version:
        raise Unreadable(f"{root}/{name}: {t['kind']} of version {t['codec']} is newer than this reader")
    try:
        df = spark.read.schema(t["schema"]).parquet(f"{root}/{t['folder']}")
        if verify and list(checksum(df)) != [t["rows"], t["checksum"]]:
            raise Unreadable(f"{root}/{name}: rows do not have the manifest's checksum")
    except Unreadable:
        raise
    except Exception as broken:  # noqa: BLE001  whatever the reader meets in damaged or missing files
        raise Unreadable(f"{root}/{name}: files are damaged or missing") from broken
    for v in range(t["codec"], codec.version):
        df = codec.lifts[v](df)
    return df.select(*spark.createDataFrame([], codec.schema).columns)


def commit(spark: SparkSession, root: str, tables: dict[str, tuple[str, DataFrame]], expected: int | None = None, keep: int = 2) -> int:
    """Writes tables (name -> (kind, rows)) as the next version and returns its number; tables not named stay as they are.

    The version before is read first, so what can't be read is never followed by another one. expected is the version that the
    rows were made from: if another one is newest by now, or becomes it meanwhile, Conflict is raised and nothing changes. A run that dies before
    the rename leaves only folders that no manifest names. Versions before the last `keep` lose their manifests.
    """
    old = manifest(spark, root)
    now = old["version"] if old else 0
    if expected is not None and expected != now:
        raise Conflict(f"{root}: version {now} is there, {expected} was expected")
    entries = dict(old["tables"]) if old else {}
    for name in entries:
        load(spark, root, name)
    for name, (kind, rows) in tables.items():
        codec = CODECS[kind]
        target = spark.createDataFrame([], codec.schema).schema
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in target))
        folder = f"data/{name}-{now + 1}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{root}/{folder}")
        n, digest = checksum(spark.read.schema(codec.schema).parquet(f"{root}/{folder}"))
        entries[name] = {"kind": kind, "codec": codec.version, "schema": codec.schema, "folder": folder, "rows": n, "checksum": digest}
    text = json.dumps({"format": FORMAT, "version": now + 1, "tables": entries}, indent=1)
    draft, final = f"{root}/draft-{uuid.uuid4().hex}.json", f"{root}/manifest-{now + 1:010}.json"
    _write(spark, draft, text)
    fs, p = _fs(spark, final)
    if fs.exists(p) or not fs.rename(_fs(spark, draft)[1], p):
        fs.delete(_fs(spark, draft)[1], False)
        raise Conflict(f"{root}: version {now + 1} was committed by another writer")
    for v in versions(spark, root)[:-keep]:
        fs.delete(_fs(spark, f"{root}/manifest-{v:010}.json")[1], False)
    return now + 1

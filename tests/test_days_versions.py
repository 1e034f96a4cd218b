"""Day normalization: sums stay, a second run changes nothing, each branch with a guard; versions: damage, age and conflict."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import day_normalization as N
from ledgerloom.sources import versions as V

H = "a" * 64
SCHEMAS = {
    "incidents": "day int, ledger long, master string, type string, t_ms long, not_closed boolean, attributable boolean, reasons array<string>, told string, mark string, basis string, hash string, verified_by string",
    "stats": "day int, ledger long, closed boolean, hash string, attributable boolean, top long, need long",
    "proofs": "day int, ledger long, closed boolean, hash string, source string, verified_by string",
    "counters": "day int, master string, ok long, partial long, missed long, wrong_hash long, no_quorum long, missed_open long",
    "hours": "day int, hour long, master string, ok long, partial long, missed long, wrong_hash long, no_quorum long, missed_open long",
    "anomaly": "day int, tag string, ledgers long, fails long", "days": "day int, quorum_fail long",
}


def inc(ledger, master, type_, day=1, t=10, not_closed=None, attributable=None, reasons=None, basis=None):
    return (day, ledger, master, type_, t, not_closed, attributable, reasons, None, None, basis, None, None)


@pytest.fixture(scope="module")
def tables(spark):
    rows = {
        "incidents": [
            inc(1, "a", "no-quorum", reasons=["no-quorum", "x"]), inc(2, "a", "no-quorum", not_closed=True), inc(3, "a", "no-quorum"), inc(4, "a", "vote-not-observed"), inc(4, "b", "vote-not-observed", basis="kept"),
            inc(5, "a", "missed", attributable=True), inc(6, "a", "missed"), inc(7, "a", "missed", reasons=["missed"]), inc(8, "b", "missed", attributable=False), inc(3, "b", "missed", t=None), inc(9, "c", "missed"), inc(9, "c", "missed", t=7_200_000),
            inc(9, "d", "partial"), inc(20, "a", "missed", day=2), inc(None, "a", "missed", day=2), inc(21, "a", "no-quorum", day=2),
        ],
        "stats": [(1, 1, True, H, None, 30, 28), (1, 3, False, H, None, 5, 28), (1, 4, True, "short", None, 20, 28), (1, 6, True, H, True, 30, 28), (1, 7, True, H, False, 30, 28), (2, 20, True, None, None, 30, 28)],
        "proofs": [(1, 1, True, "b" * 64, "explorer", "two nodes"), (1, 9, None, "not hex", "x", None)],
        "counters": [(1, "a", 5, 0, 3, 0, 2, None), (1, "b", 1, 0, 1, 0, 0, 4), (2, "a", 1, 0, 2, 0, 1, 0), (1, "z", 1, 0, 9, 0, 0, 0)],
        "hours": [(1, 0, "a", 5, 0, 1, 0, 0, None), (1, 2, "c", 0, 0, 1, 0, 0, 0), (1, 0, "b", 0, 0, 0, 0, 0, 0)],
        "anomaly": [(1, "no-quorum", 4, 2), (1, "spike", 1, 1), (2, "no-quorum", 3, None), (2, "vote-not-observed", 1, 1)],
        "days": [(1, 1), (2, 0), (3, 5)],
    }
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def plain(df):
    return sorted(map(str, df.collect()))


def test_types_and_marks(spark, tables):
    out = N.normalized(tables)
    got = {(r.day, r.ledger, r.master, r.t_ms): (r.type, r.told, r.mark, r.basis, r.reasons, r.hash, r.verified_by) for r in out["incidents"].collect()}
    seen, missed = "vote-not-observed", "missed"
    stream = "validated-ledger-stream"
    assert got[1, 1, "a", 10] == (seen, "no-quorum", None, "explorer", [seen, "x"], "b" * 64, "two nodes")
    assert got[1, 2, "a", 10][:2] == ("no-quorum", None) and got[1, 3, "a", 10][:2] == ("no-quorum", None)
    assert got[1, 4, "a", 10][:4] == (seen, None, None, stream) and got[1, 4, "b", 10][3] == "kept"
    assert got[1, 5, "a", 10][:2] == (missed, None) and got[1, 6, "a", 10][:2] == (missed, None)
    assert got[1, 7, "a", 10] == (seen, missed, "not-attributable", stream, [seen], H, None)
    assert got[1, 8, "b", 10][:4] == (seen, missed, "not-attributable", stream) and got[1, 3, "b", None][:4] == ("no-quorum", missed, "not-recorded", None)
    assert got[1, 9, "c", 10][:3] == (seen, missed, "not-recorded") and got[2, None, "a", 10][0] == seen and got[1, 9, "d", 10][0] == "partial"
    assert {(r.ledger, r.closed) for r in out["stats"].where("day = 1").collect()} >= {(4, None), (1, True), (3, False)}


def test_counters_move_and_sums_stay(spark, tables):
    out = N.normalized(tables)
    c = {(r.day, r.master): (r.missed, r.no_quorum, r.missed_open) for r in out["counters"].collect()}
    assert c == {(1, "a"): (2, 3, 1), (1, "b"): (0, 1, 5), (2, "a"): (0, 3, 2), (1, "z"): (9, 0, 0)}
    h = {(r.hour, r.master): (r.missed, r.no_quorum, r.missed_open) for r in out["hours"].collect()}
    assert h == {(0, "a"): (0, 1, 1), (2, "c"): (0, 1, 1), (0, "b"): (0, 0, 0)}
    total = lambda df: tuple(df.agg(F.sum(F.coalesce("missed", F.lit(0)) + F.col("no_quorum")), F.sum("ok"), F.count("*")).first())
    for name in ("counters", "hours"):
        assert total(out[name]) == total(tables[name])
    assert plain(out["moved"]) == plain(spark.createDataFrame([(1, 2, 2, 2), (2, 2, 0, 0)], "day int, moved long, proven long, counter_gaps long"))
    a = {(r.day, r.tag): (r.ledgers, r.fails) for r in out["anomaly"].collect()}
    assert a == {(1, "no-quorum"): (4, 2), (1, "spike"): (1, 1), (2, "no-quorum"): (0, 0), (2, "vote-not-observed"): (4, 1)}
    assert {tuple(r) for r in out["gaps"].collect()} == {(1, "no-quorum", 4, "closure-denied-in-same-counter"), (1, "quorum-fail", 1, "forensics-rows-exceed-counter"), (3, "quorum-fail", 5, "counter-without-forensics-row")}


def test_a_second_run_changes_nothing(spark, tables):
    once = N.normalized(tables)
    twice = N.normalized(once)
    for name in SCHEMAS:
        assert plain(twice[name]) == plain(once[name]), name
    assert twice["moved"].agg(F.sum("moved")).first()[0] == 0
    empty = N.normalized({k: v.limit(0) for k, v in tables.items()})
    assert all(df.isEmpty() for df in empty.values())


def windows(spark, n):
    return spark.range(n).selectExpr("id as ledger", "id * 4000 as close_ms", "1L as tx_count", "0L as malicious", "0L as suspect")


def test_versions_round_trip_and_conflict(spark, tmp_path):
    root = str(tmp_path / "s")
    assert V.manifest(spark, root) is None
    assert V.commit(spark, root, {"w": ("window", windows(spark, 5))}, expected=0) == 1
    first = V.load(spark, root, "w")
    assert V.commit(spark, root, {"w": ("window", first.unionByName(windows(spark, 7).where("ledger >= 5"))), "j": ("jobs", spark.createDataFrame([], V.CODECS["jobs"].schema))}, expected=1) == 2
    assert V.load(spark, root, "w").count() == 7 and V.load(spark, root, "j").count() == 0
    with pytest.raises(V.Conflict):
        V.commit(spark, root, {"w": ("window", windows(spark, 1))}, expected=1)
    assert V.commit(spark, root, {"j": ("jobs", spark.createDataFrame([("a", 1, 2, "open", 3)], V.CODECS["jobs"].schema))}) == 3
    assert V.load(spark, root, "w").count() == 7 and V.versions(spark, root) == [2, 3]
    with pytest.raises(V.Unreadable):
        V.load(spark, root, "nothing")


def test_damage_is_refused_and_not_written_over(spark, tmp_path):
    root = str(tmp_path / "d")
    V.commit(spark, root, {"w": ("window", windows(spark, 5).coalesce(1))})
    folder = f"{root}/{V.manifest(spark, root)['tables']['w']['folder']}"
    extra = windows(spark, 1)
    extra.write.mode("append").parquet(folder)  # rows that no manifest knows
    for act in (lambda: V.load(spark, root, "w"), lambda: V.commit(spark, root, {"w": ("window", extra)})):
        with pytest.raises(V.Unreadable):
            act()
    for f in glob.glob(f"{folder}/*.parquet"):
        os.remove(f)
    with pytest.raises(V.Unreadable):
        V.load(spark, root, "w")
    at = f"{root}/manifest-{1:010}.json"
    whole = open(at).read()
    for text in (whole[: len(whole) // 2], "[]", whole.replace('"rows"', '"lines"'), whole.replace('"format": 1', '"format": 9'), whole.replace('"codec": 1', '"codec": 9')):
        for f in glob.glob(f"{root}/.manifest-*.crc"):
            os.remove(f)
        with open(at, "w") as out:
            out.write(text)
        for act in (lambda: V.load(spark, root, "w"), lambda: V.commit(spark, root, {"w": ("window", extra)})):
            with pytest.raises(V.Unreadable):
                act()
        assert V.versions(spark, root) == [1]


def test_older_codecs_are_lifted(spark, tmp_path, monkeypatch):
    root, newest = str(tmp_path / "o"), V.CODECS["state"]
    old = newest.schema.removesuffix(", members array<string>")
    monkeypatch.setitem(V.CODECS, "state", V.Codec(1, old))
    V.commit(spark, root, {"s": ("state", spark.createDataFrame([("c", 1, 1, 1, 1, 1, 1)], old))})
    monkeypatch.setitem(V.CODECS, "state", newest)
    assert V.load(spark, root, "s").first().members == []
    V.commit(spark, root, {"s": ("state", V.load(spark, root, "s"))})
    monkeypatch.setitem(V.CODECS, "state", V.Codec(1, old))
    with pytest.raises(V.Unreadable):  # an older reader does not touch it
        V.commit(spark, root, {"s": ("state", spark.createDataFrame([], old))})


def test_of_several_proofs_the_smallest_counts(spark):
    from ledgerloom.sources.days import with_addendum

    day = spark.createDataFrame([(1, None), (2, "known"), (3, None)], "ledger bigint, hash string")
    proofs = spark.createDataFrame([(1, "c"), (1, None), (1, "b"), (2, "a"), (3, None)], "ledger bigint, hash string")
    for order in (proofs, proofs.orderBy("hash")):
        assert sorted(map(tuple, with_addendum(day, order, ["ledger"], "hash").collect())) == [(1, "b"), (2, "known"), (3, None)]


def test_days_are_replaced_and_a_large_one_is_split(spark, tmp_path):
    from ledgerloom.sources.days import write_days

    path = str(tmp_path / "days")
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 10 = 0 THEN DATE'2024-01-02' ELSE DATE'2024-01-01' END AS day", "id", "sha2(cast(id AS string), 256) AS text")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        for _ in range(2):  # again gives the same table
            write_days(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    write_days(rows.where("id = 10"), path)
    back = spark.read.parquet(path)
    assert {str(r.day): r["count"] for r in back.groupBy("day").count().collect()} == {"2024-01-01": 180_000, "2024-01-02": 1}
    assert len(list((tmp_path / "days" / "day=2024-01-01").glob("*.parquet"))) > 1

import datetime as dt

from ledgerloom.operators.state import merge_clusters
from ledgerloom.streaming import tracker as S

T0 = dt.datetime(2026, 1, 1)


def source(spark, tmp_path, name, parts, schema):
    folder = tmp_path / name
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_tally_closes_cells_after_the_grace(spark, tmp_path):
    schema = "ts timestamp, master string, hash string"
    parts = [[(at(1), "a", "x"), (at(2), "b", "x"), (at(2), "b", "x"), (at(3), "c", "x"), (at(4), "c", "y")], [(at(11), "a", "z"), (at(12), "b", "w")], [(at(45), "a", "x")], [(at(46), "b", "q")]]
    found = {r.start: (r.votes, r.top_hash, r.top) for r in drained(spark, S.tally_stream(source(spark, tmp_path, "v", parts, schema)), "tally").collect()}
    assert found[at(0)] == (3, "x", 2) and found[at(10)] == (2, "w", 1) and at(40) not in found


def test_shapes_count_a_hash_once(spark, tmp_path):
    schema = "ts timestamp, hash string, account string, destination string"
    parts = [[(at(1), "h1", "a", "b"), (at(1), "h1", "a", "b"), (at(2), "h2", "a", "c")], [(at(200), "h3", "a", "b")], [(at(201), "h4", "a", "b")]]
    found = {r.start: (r.tx_count, r.senders, r.receivers) for r in drained(spark, S.shape_stream(source(spark, tmp_path, "t", parts, schema)), "shape").collect()}
    assert found[at(0)] == (2, 1, 2)


def test_dusting_state_reports_once(spark, tmp_path):
    schema = "account string, destination string, amount_drops long"
    parts = [[("a", "x", 5), ("a", "y", 5), ("b", "x", 500)], [("a", "y", 5), ("b", "y", 500), ("b", "z", 5)], [("a", "z", 5)], [("a", "q", 5), ("b", "x", 1)]]
    found = drained(spark, S.tiny_destinations(source(spark, tmp_path, "d", parts, schema)), "dust").collect()
    assert [(r.account, r.destinations) for r in found] == [("a", 3)]


def test_live_classes(spark, tmp_path):
    schema = "hash string, account string, destination string, type string, amount_drops long"
    watched = spark.createDataFrame([("w",)], "address string")
    parts = [[("1", "a", "w", "Payment", 5), ("2", "a", "w", "Payment", 500), ("3", "w", "a", "Payment", 5), ("4", "a", "w", "TrustSet", None), ("5", "a", "b", "Payment", 5)]]
    found = drained(spark, S.classified(source(spark, tmp_path, "c", parts, schema), watched), "live").collect()
    assert {r.hash: r["class"] for r in found} == {"1": "dust", "2": "incoming", "3": "outgoing", "4": "contact"}


def test_advance_equals_one_batch(spark, tmp_path):
    schema = "cluster string, total_drops long, tx_count long, first_seen long, last_seen long, role_rank long, severity_rank long"
    parts = [[("a", 1, 1, 5, 5, 1, 1), ("b", 2, 1, 5, 6, 2, 1)], [("a", 3, 1, 2, 9, 1, 3)], [("c", 4, 1, 1, 1, 1, 1)]]
    empty = spark.createDataFrame([], schema)
    fold = lambda old, new: merge_clusters(empty if old is None else old, new)
    q = S.advance(source(spark, tmp_path, "s", parts, schema), str(tmp_path / "state"), fold, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "state" / "3"))
    want = merge_clusters(empty, spark.createDataFrame(sum(parts, []), schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

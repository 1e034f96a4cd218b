import json

import pytest

from pyspark.sql import functions as F

from ledgerloom.sources import days, ledger as L


def root(account, before, after):
    return {"ModifiedNode": {"LedgerEntryType": "AccountRoot", "FinalFields": {"Account": account, "Balance": after}, "PreviousFields": {"Balance": before}}}


IOU = {"currency": "USD", "issuer": "rI", "value": "2.5"}
ENTRIES = [
    {"tx_json": {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": "500", "DestinationTag": 0}, "meta": {"TransactionResult": "tesSUCCESS", "delivered_amount": "400"}, "hash": "H1", "ledger_index": 7, "close_time_iso": "2026-01-01T00:00:00Z"},
    {"tx": {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": "500", "hash": "H2"}, "metaData": {"TransactionResult": "tecPATH_DRY"}, "ledger_index": 7},
    {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": "500", "hash": "H3", "close_time": 10},
    {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": "500", "SendMax": "9", "hash": "H4", "meta": {"AffectedNodes": [root("rB", "100", "170"), root("rA", "900", "800")]}},
    {"TransactionType": "Payment", "Account": "rA", "Destination": "rA", "Amount": "500", "SendMax": "9", "hash": "H5", "meta": {"AffectedNodes": [root("rA", "100", "170")]}},
    {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": IOU, "hash": "H6"},
    {"TransactionType": "Payment", "Account": "rA", "Destination": "rB", "Amount": "5", "hash": "H7", "meta": {"delivered_amount": IOU}},
    {"TransactionType": "OfferCreate", "Account": "rA", "Amount": "500", "hash": "H8"},
    {"TransactionType": "EscrowFinish", "Account": "rA", "Owner": "rO", "hash": "H9", "SourceTag": "x"},
    {"TransactionType": "Batch", "Account": "rA", "hash": "HB", "ledger_index": 9, "RawTransactions": [{"RawTransaction": {"TransactionType": "Payment", "Account": "rC", "Destination": "rD", "Amount": "77"}}, {"RawTransaction": {}}]},
    {"TransactionType": "TrustSet", "Account": "rA", "LimitAmount": IOU, "hash": "HT", "DestinationTag": "7", "Memos": [{"Memo": {"MemoData": "68c3a9", "MemoFormat": "zz"}}, {"Memo": {"MemoData": "ff21"}}]},
    {"hello": 1},
]


def rows(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(json.dumps(e) for e in ENTRIES) + "\nnot json\n")
    return L.expand_batches(L.normalized(L.read_entries(spark, str(tmp_path / "in.json"), strict=False)))


def test_records(spark, tmp_path):
    by = {r.hash or f"in:{r.inner_of}": r for r in L.records(rows(spark, tmp_path)).collect()}
    assert {k: r.amount_drops for k, r in by.items()} == {"H1": 400, "H2": None, "H3": 500, "H4": 70, "H5": None, "H6": None, "H7": None, "H8": None, "H9": None, "HB": None, "in:HB": 77, "HT": None}
    assert by["H1"].destination_tag == 0 and by["H1"].ledger_seq == 7 and by["H1"].close_time == "2026-01-01T00:00:00Z"
    assert by["H3"].close_time == "2000-01-01T00:00:10.000Z"
    assert by["H6"].issued.asDict() == {"currency": "USD", "issuer": "rI", "value": 2.5} and by["H7"].issued is not None and by["H3"].issued is None
    assert by["H9"].destination == "rO" and by["H9"].source_tag is None and by["HT"].destination_tag is None
    assert by["in:HB"].ledger_seq == 9 and by["in:HB"].account == "rC"


def test_actors_memos_counterparties(spark, tmp_path):
    df = rows(spark, tmp_path)
    by = {r.hash: r for r in df.select("tx.hash", L.actors().alias("actors"), L.memo_text().alias("memo")).collect()}
    assert by["HT"].actors == ["rA", "rI"] and by["H6"].actors == ["rA", "rB", "rI"] and by["HT"].memo == "hé �!"
    both = {(r.address, r.other, r.direction, r.type) for r in L.counterparties(df).collect()}
    assert {("rA", "rI", "in", "TrustSet"), ("rI", "rA", "out", "TrustSet"), ("rC", "rD", "out", "Payment"), ("rB", "rA", "in", "Payment")} <= both
    assert all(a != b for a, b, *_ in both)


def test_days_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([("2026-01-01", 1, None), ("2026-01-02", 2, True), ("2026-01-03", 3, None)], "day string, ledger long, closed boolean").withColumn("day", F.col("day").cast("date"))
    days.write_days(df, path)
    days.write_days(df.where("ledger = 2").withColumn("ledger", F.lit(20).cast("long")), path)
    assert sorted(r.ledger for r in spark.read.parquet(path).collect()) == [1, 3, 20]
    recent = days.read_days(spark, path, "2026-01-03", "24h")
    assert [r.ledger for r in recent.collect()] == [3] and "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()
    proof = spark.createDataFrame([(1, True), (1, True), (2, False)], "ledger long, closed boolean")
    assert {r.ledger: r.closed for r in days.with_addendum(df, proof, ["ledger"], "closed").collect()} == {1: True, 2: True, 3: None}


def test_csv_report_has_crlf(spark, tmp_path):
    from ledgerloom.operators.causes import csv_line

    df = spark.createDataFrame([("a", 'say "hi"', None), ("b,c", "x", 1)], "m string, n string, k int").coalesce(1)
    days.write_csv_report(df.select(csv_line("m", "n", "k").alias("line")), str(tmp_path / "r"), "m,n,k")
    text = b"".join(p.read_bytes() for p in (tmp_path / "r").glob("part*"))
    assert text == b'm,n,k\r\na,"say ""hi""",\r\n"b,c",x,1\r\n'


def test_broken_lines_end_the_job(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"TransactionType": "Payment", "Account": "a"}\n{"TransactionType": "Pay\n')
    assert L.read_entries(spark, str(tmp_path / "bad.json"), strict=False).count() == 1
    with pytest.raises(Exception, match="broken line"):
        L.read_entries(spark, str(tmp_path / "bad.json")).collect()

"""Context, confirmation, watchlists, countries, assets, alerts and guidance on literal frames."""

from pyspark.sql import functions as F

from ledgerloom.functions import assets as A
from ledgerloom.operators import causes as C, context as X, evidence as E

TX = "hash string, ledger_seq long, account string, destination string, amount_drops long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_protected_ends_and_null_ends(spark):
    tx = spark.createDataFrame([("1", 1, "A", "B", 5), ("2", 1, "P", "B", 5), ("3", 1, "A", "P", 5), ("4", 1, "A", None, 5)], TX)
    listed = spark.createDataFrame([("P",), ("P",), (None,)], "address string")
    left = X.without(tx, listed, "account", "destination")
    assert left.columns == tx.columns and [r[0] for r in rows(left)] == ["1", "4"]
    assert X.without(tx, listed.limit(0), "account", "destination").count() == 4


def test_context_precedence(spark):
    seen = lambda *r: spark.createDataFrame(list(r), "address string, first_seen long")
    out = lambda *r: spark.createDataFrame(list(r), "address string, out_drops long")
    names = lambda *r: spark.createDataFrame([(x,) for x in r], "address string")
    got = X.detection_context(seen(("A", 9), ("B", None), ("R", 1), ("P", 1)), seen(("A", 3), ("B", 7), ("B", 5)), seen(("A", 1), ("R", 2), ("C", 4)), out(("A", 0), ("R", 8)), out(("A", 70), ("D", 30), ("P", 1)), names("R"), names("P"))
    # A: knowledge goes first, no drops in history are a null; R: only the state, as it is registered
    assert rows(got) == [("A", True, 9, True, None), ("B", True, 5, False, None), ("C", False, 4, False, None), ("D", False, None, True, 30), ("R", False, 2, False, None)]


def test_confirmed_sweep(spark):
    tx = spark.createDataFrame([("a", 1, "S", "V", 100), ("b", 2, "V", "T", 90), ("c", 1, "S", "W", 100), ("d", 2, "W", "T", 89), ("e", 1, "T2", "U", 100), ("f", 2, "U", "T2", 95)], TX)
    touched = spark.createDataFrame([("V", True), ("W", True), ("U", False), ("V", False), ("Z", True)], "address string, created boolean")
    assert rows(X.confirmed_sweeps(touched, tx)) == [("V", 0.9, 90, "malicious")]  # W takes too little, U pays its payer back
    held = spark.createDataFrame([("b", 1000), ("d", 89)], "hash string, balance long")
    assert rows(X.confirmed_sweeps(touched, tx, held)) == [("W", 1.0, 89, "malicious")]
    assert rows(X.confirmed_sweeps(touched, tx, newest=1)) == []  # the receipt is not among the newest


def test_payments_of_sweeps_are_ranked_once(spark):
    tx = spark.createDataFrame([("a", 1, "S", "V", 100), ("b", 2, "V", "T", 90)], TX)
    got = X.confirmed_sweeps(spark.createDataFrame([("V", True)], "address string, created boolean"), tx)
    assert rows(got) == [("V", 0.9, 90, "malicious")] and "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_watchlist_and_listed(spark):
    reg = spark.createDataFrame([("m1", "x", ["u"], 1), ("m2", "x", ["u", "v"], 3), ("m3", "", ["u"], 9), ("m4", None, ["u"], 9), ("m5", "y", ["w"], 9), ("m6", "z", None, 9), ("m7", "z", ["v"], None)], "master string, domain string, lists array<string>, last_seen long")
    assert [r[0] for r in X.watchlist(reg, ["u", "v"]).collect()] == ["m2", "m1", "m7"]
    assert [r[0] for r in X.watchlist(reg, ["u", "v"], 1).collect()] == ["m2"]
    keys = spark.createDataFrame([("m1",), ("m3",), ("q",), ("q",)], "master string")
    assert rows(X.listed_masters(keys, reg)) == [("m1", "x", True), ("m3", None, True), ("q", None, False)]


def test_countries_fold_compatibility_forms(spark):
    names = spark.createDataFrame([("ＦＲＡＮＣＥ",), (" france ",), ("usa",), ("Côte",), ("",), (None,), ("Nowhere",)], "name string")
    countries = spark.createDataFrame([("France",), ("United States",), ("CÔTE",)], "country string")
    aliases = spark.createDataFrame([("USA", "united states"), ("X", "Nowhere")], "alias string, country string")
    got = {r[0]: r[1] for r in X.matched_countries(names, countries, aliases).collect()}
    assert got == {"ＦＲＡＮＣＥ": "France", " france ": "France", "usa": "United States", "Côte": "CÔTE", "": None, None: None, "Nowhere": None}


def test_totals_and_fraud_first(spark):
    b = spark.createDataFrame([("2", 3), ("x", None), (None, 4)], "blocks string, txns long")
    assert rows(X.window_totals(b, "blocks", "txns")) == [(2, 7)] and rows(X.window_totals(b.limit(0), "blocks", "txns")) == [(0, 0)]
    c = spark.createDataFrame([("a", ["r"], 1), ("b", [], 9), ("c", None, 9), ("d", ["r"], 5)], "key string, rules array<string>, last_seen long")
    assert [r.key for r in X.fraud_first(c, ["r"], 3).collect()] == ["d", "a", "b"]


def test_asset_sides(spark):
    amount = "struct<currency:string,issuer:string,value:string>"
    df = spark.createDataFrame([((None, None, "100"), ("USD", "r1", "4")), (("USD", "r1", "4"), (None, None, "100")), (("usd", "r1", "4"), (None, None, "100")), ((None, None, "0"), ("USD", "r1", "4")), (("00112233445566AA", "r1", "2"), ("USD", "r1", "4")), ((None, None, "x"), ("USD", "", "4"))], f"gets {amount}, pays {amount}")
    got = [tuple(r) for r in df.select(A.side_key(F.col("gets")), A.side_value(F.col("gets")), A.fill_rate(F.col("gets"), F.col("pays"))).collect()]
    # XRP stands above USD:r1 by name, so the rate is drops over USD both ways
    assert got == [("XRP", 100.0, 25.0), ("USD:r1", 4.0, 25.0), (None, 4.0, None), ("XRP", 0.0, None), ("00112233445566AA:r1", 2.0, 2.0), (None, None, None)]
    p = spark.createDataFrame([([], None), ([1], None), (None, (None, None, "9")), ([], ("USD", "r1", "9"))], f"paths array<int>, most {amount}").withColumn("amount", F.lit(None).cast(amount))
    p = p.withColumn("amount", F.struct(F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("issuer"), F.lit("5").alias("value")))
    assert [r[0] for r in p.select(A.pays_same_asset(F.col("paths"), F.col("most"), F.col("amount"))).collect()] == [True, False, True, False]


def test_health_alerts_each_with_guard(spark):
    schema = "master string, day long, revoked boolean, score double, missed long, total long, incomplete boolean, signing_key string, list string"
    info = spark.createDataFrame([("a", 1, False, 0.95, 10, 200, False, "k", "u"), ("a", 2, True, 0.94, 11, 200, False, "k2", None), ("a", 3, None, 0.1, 150, 199, False, None, "v"), ("a", 4, False, 0.1, 150, 200, True, "k3", "w"), ("b", 4, False, None, None, None, None, "k3", "w")], schema)
    got = [(r.day, r.alert, r.severity, r.value) for r in C.health_alerts(info, "day").orderBy("day", "alert").collect()]
    assert got == [(2, "agreement-drop", "suspect", 0.94), (2, "missed-surge", "suspect", 5.5), (2, "signing-key-rotated", "suspect", None), (2, "validator-revoked", "malicious", None), (4, "unl-membership-changed", "suspect", None)]


def test_guidance_of_scopes_and_tags(spark):
    i = spark.createDataFrame([(1, "a", "missed", "network", False), (2, "a", "missed", "network", None), (3, "a", "wrong-hash", "solo", True), (4, "a", "missed", "capture-cohort", True), (5, "a", "missed", "cohort", True)], "ledger long, master string, type string, scope string, closed boolean")
    h = spark.createDataFrame([(1, "a", "hash-split", "measured", None), (3, "a", "type-burst:X", "context", None), (3, "a", "feature-change", "correlated", None), (5, "a", "close-gap", "context", True), (4, "a", "close-gap", "measured", False)], "ledger long, master string, tag string, strength string, continuous boolean")
    got = {}
    for r in E.guidance(i, h).collect():
        got.setdefault(r.ledger, set()).add(r.check)
    assert got == {1: {"network-stall", "report-split"}, 2: {"capture-window", "unknown-cause"}, 3: {"solo-peering", "solo-resources", "version-state", "attack-type-burst"}, 4: {"capture-window"}, 5: {"cohort-network", "network-stall", "unknown-cause"}}

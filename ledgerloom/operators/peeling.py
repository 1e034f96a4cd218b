"""Forwarding chains from flagged seeds: in the part that seeds reach and that reaches seeds, over accumulated state, with owners and habits.

tx: (hash, account, destination, amount_drops, ledger_seq, fee_drops, to_tag, from_tag); flags: (address, rank). A relay
has one hop in and one out, so a chain has one way on and a walk is a pointer that is followed by at most `longest` joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept, small

HOP = ["hash", "account", "destination", "amount_drops", "ledger_seq", "fee_drops", "to_tag", "from_tag"]


def reached(edges: DataFrame, starts: DataFrame, src: str = "account", dst: str = "destination", most: int = 1 << 20) -> DataFrame:
    """(node, side): nodes that starts (node) reach (side `from`) and that reach starts (side `to`), starts included.

    Both searches share their rounds, as many as the longest shortest way; a round joins the last round's nodes only. Once these
    are at most `most`, they are broadcast, so that neither the arcs nor the nodes seen are shuffled again in each of the rounds.
    """
    key = ["node", "side"]
    pair = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    arcs = kept(pair.select("node", "next", F.lit("from").alias("side")).unionByName(pair.select(F.col("next").alias("node"), F.col("node").alias("next"), F.lit("to").alias("side"))))
    front = kept(starts.select("node").distinct().select("node", F.explode(F.array(F.lit("from"), F.lit("to"))).alias("side")))
    seen, rounds, n = front, 0, front.count()
    while n:
        found = arcs.join(F.broadcast(front) if n <= most else front, key, "left_semi").select(F.col("next").alias("node"), "side").distinct()
        known = seen
        if n <= most:
            found = kept(found)
            if small(found, most):
                known = F.broadcast(seen.join(F.broadcast(found), key, "left_semi"))
        front = kept(found.join(known, key, "left_anti"))
        seen, rounds, n = seen.unionByName(front), rounds + 1, front.count()
        if rounds % 8 == 0:  # one table instead of one for each round
            seen = kept(seen)
    return seen


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(s, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def habits(hops: Column, fee: float = 0.1, least: int = 3, gap: float = 10.0, variance: float = 36.0) -> Column:
    """Array of the habits of a program that a chain's hops (structs of HOP and peel_drops, in order) show.

    Fees near their median (two at least), an amount or peel that occurs twice, even gaps of three hops or more, a tag used again.
    """
    field = lambda name: F.transform(hops, lambda h: h[name].cast("double"))
    known = lambda *names: F.filter(F.concat(*map(field, names)), lambda x: x.isNotNull())
    fees = F.filter(known("fee_drops"), lambda x: x > 0)
    mid = _median(fees)
    even_fees = (F.size(fees) >= 2) & F.forall(fees, lambda x: F.abs(x - mid) <= mid * fee)
    twice = lambda values: F.size(F.array_distinct(values)) < F.size(values)
    seqs = known("ledger_seq")
    gaps = F.transform(F.sequence(F.lit(1), F.size(seqs) - 1), lambda k: F.abs(F.get(seqs, k) - F.get(seqs, k - 1)))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size(gaps)
    spread = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(gaps)
    even = F.when((F.size(hops) >= least) & (F.size(seqs) == F.size(hops)), (_median(gaps) <= gap) & (spread <= variance))
    named = (("fee-constancy", even_fees), ("amount-duplicates", twice(known("amount_drops", "peel_drops"))), ("interval-regularity", even), ("tag-reuse", twice(known("to_tag", "from_tag"))))
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named)))


def _marked(tx: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payments between two accounts, with the ranks of both; the greatest rank of each flagged address)."""
    rank = kept(flags.where("address is not null").groupBy("address").agg(F.max("rank").alias("rank")))
    missing = [F.lit(None).cast("bigint").alias(c) for c in HOP if c not in tx.columns]
    t = tx.select("*", *missing).select(HOP).where("account is not null and destination is not null and account <> destination")
    for end in ("account", "destination"):
        t = t.join(rank.select(F.col("address").alias(end), F.col("rank").alias(f"{end}_rank")), end, "left")
    return kept(t), rank


def _busy(marked: DataFrame, hub: int) -> DataFrame:
    """(node) of unflagged accounts with more than `hub` of these payments."""
    ends = marked.select(F.col("account").alias("node"), F.col("account_rank").alias("rank")).unionByName(marked.select(F.col("destination").alias("node"), F.col("destination_rank").alias("rank")))
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.max("rank").alias("rank")).where((F.col("n") > hub) & F.col("rank").isNull()).select("node")


def _relays(hops: DataFrame, busy: DataFrame, degree: int) -> DataFrame:
    """(node, in_drops, in_seq, way): nodes with one hop in and one out, with the latter."""
    if degree < 2:
        return hops.select(F.col("account").alias("node"), F.col("amount_drops").alias("in_drops"), F.col("ledger_seq").alias("in_seq"), F.struct(*HOP, F.col("destination_rank")).alias("way")).limit(0)
    out = hops.groupBy(F.col("account").alias("node")).agg(F.count("*").alias("n"), F.max(F.struct(*HOP, "destination_rank")).alias("way")).where("n = 1").drop("n")
    into = hops.groupBy(F.col("destination").alias("node")).agg(F.count("*").alias("n"), F.max("amount_drops").alias("in_drops"), F.max("ledger_seq").alias("in_seq")).where("n = 1").drop("n")
    return out.join(into, "node").join(busy, "node", "left_anti")


def _hop(way, ratio: Column, peel: Column) -> Column:
    return F.struct(*(way(c).alias(c) for c in HOP), ratio.cast("double").alias("ratio"), peel.cast("bigint").alias("peel_drops"))


def _walked(first: DataFrame, step: DataFrame, ok, enough: Column, longest: int, most: int = 1 << 20) -> DataFrame:
    """Chains (path, hops, bridges, remainders) that are `enough`, from their first hop on while a step (node, in_drops, in_seq, way, peels) is allowed.

    ok(ratio, step's peel) tells how a step counts: null for none, else the peel (0 in the classic channel). Steps that count on no path
    are left out first, chains that end before they are enough at once; up to `most` open chains pick their steps by a broadcast.
    """
    nothing = F.lit(None)
    ratio = F.when(F.col("in_drops") > 0, F.col("way.amount_drops") / F.col("in_drops"))
    peel = lambda peels: F.get(peels, F.lit(0))["amount_drops"]
    step = kept(step.withColumn("ratio", ratio).where(ok(F.col("ratio"), peel("peels")).isNotNull()))
    level = kept(first.select(F.array("account", "destination").alias("path"), F.array(_hop(F.col, nothing, nothing)).alias("hops"), F.when(F.col("destination_rank").isNull(), F.array("destination")).otherwise(F.array().cast("array<string>")).alias("bridges"), F.lit(0).alias("remainders"), F.col("account_rank").alias("seed_rank")))
    columns, done = level.columns, None
    for _ in range(longest - 1):
        n = level.count()
        if not n:
            break
        at = step.join(F.broadcast(level.select(F.element_at("path", -1).alias("node"))), "node", "left_semi") if n <= most else step
        j = level.join(at, F.element_at("path", -1) == F.col("node"), "left")
        peeled = peel(F.filter("peels", lambda p: ~F.array_contains("path", p["destination"])))
        j = j.withColumn("channel", F.when(F.col("node").isNotNull() & ~F.array_contains("path", F.col("way.destination")), ok(F.col("ratio"), peeled)))
        on, remainder = F.col("channel").isNotNull(), F.col("channel") > 0
        hop = _hop(lambda c: F.col(f"way.{c}"), F.col("ratio"), F.when(remainder, F.col("channel")))
        to = F.array("way.destination")
        after = {"path": F.concat("path", to), "hops": F.concat("hops", F.array(hop)), "bridges": F.when(F.col("way.destination_rank").isNull(), F.concat("bridges", to)).otherwise(F.col("bridges")), "remainders": F.col("remainders") + remainder.cast("int")}
        both = kept(j.where(on | enough).select(*(F.when(on, x).otherwise(F.col(c)).alias(c) for c, x in after.items()), "seed_rank", on.alias("open")))
        ended, level = both.where("NOT open").select(columns), both.where("open").select(columns)
        done = ended if done is None else done.unionByName(ended)
    level = level.where(enough)
    return level if done is None else done.unionByName(level)


def _reported(chains: DataFrame, chains_most: int | None, high: int = 3) -> DataFrame:
    """One chain of each path (the first by first hop), with its habits; at most so many, in the order of seeds and first hops, if a number is given."""
    first = F.col("hops")[0]
    order = [F.col("path")[0], F.col("path")[1], F.coalesce(first["ledger_seq"], F.lit(-1)), F.coalesce(first["hash"], F.lit(""))]
    c = chains.withColumn("signature", F.array_join("path", ","))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("signature").orderBy(*order[2:]))).where("_n = 1").drop("_n")
    if chains_most is not None:
        c = c.orderBy(*order).limit(chains_most)
    c = c.withColumn("habits", habits(F.col("hops")))
    by_time = F.transform(F.array_sort(F.transform("hops", lambda h: F.struct(F.coalesce(h["ledger_seq"], F.lit(-1)).alias("s"), F.coalesce(h["hash"], F.lit("")).alias("k"), h.alias("h")))), lambda x: x["h"])
    return c.select("signature", F.col("path")[0].alias("seed"), "seed_rank", "path", by_time.alias("hops"), F.size("hops").cast("bigint").alias("hop_count"), F.array_sort("bridges").alias("bridges"), F.col("remainders").cast("bigint").alias("remainder_hops"), "habits", F.size("habits").cast("bigint").alias("score"), (F.size("habits") >= high).alias("high"))


def seeded_chains(tx: DataFrame, flags: DataFrame, low: float = 0.6, high: float = 0.95, least: int = 3, dust: int = 100, rest_low: float = 0.95, rest_high: float = 1.0, peel: float = 0.01, rest_least: int = 2, longest: int = 8, degree: int = 4, hub: int = 20, seeds: int | None = None, chains: int | None = None) -> DataFrame:
    """Chains from flagged seeds over unflagged relays, up to the next flagged account: (signature, seed, seed_rank, path, hops, ...).

    Only hops from an account that a seed reaches to one that reaches a seed count, also in the relays' degree. A hop passes on low to high of
    what came in, or, in the remainder channel, rest_low to below rest_high, if another payment of the relay to an account off the
    path peels off more than dust and at most the share `peel`. Chains with a hop of that channel need rest_least hops, others `least`.
    More than `hub` payments with flagged accounts make no relay. seeds and chains are limits for reports; without them all are given.
    """
    t, rank = _marked(tx, flags)
    start = rank.select(F.col("address").alias("node"))
    side = kept(reached(t, start))
    of = lambda which, end: side.where(F.col("side") == which).select(F.col("node").alias(end))
    near = kept(t.join(of("from", "account"), "account", "left_semi").join(of("to", "destination"), "destination", "left_semi"))
    busy = _busy(t.where("account_rank is not null or destination_rank is not null"), hub)
    relay = kept(_relays(near, busy, degree).join(start, "node", "left_anti"))
    # Of each relay the first small payments to different accounts, one more than a path can hold.
    small = t.select(F.col("account").alias("node"), "destination", "amount_drops", "ledger_seq", "hash").join(relay.select("node", "in_drops", F.col("way.destination").alias("_to")), "node")
    small = small.where((F.col("destination") != F.col("_to")) & (F.col("amount_drops") > dust) & (F.col("amount_drops") <= F.col("in_drops") * peel))
    key = F.struct(F.coalesce("ledger_seq", F.lit(-1)).alias("s"), F.coalesce("hash", F.lit("")).alias("h"), "destination", "amount_drops")
    small = small.groupBy("node", "destination").agg(F.min(key).alias("k")).withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("k"))).where(F.col("n") <= longest + 1)
    peels = small.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.struct(k["destination"].alias("destination"), k["amount_drops"].alias("amount_drops"))).alias("peels"))  # longest + 1 at most
    step = relay.join(peels, "node", "left")

    def ok(ratio: Column, peeled: Column) -> Column:
        enough = F.col("way.amount_drops") > dust
        return F.when(enough & ratio.between(low, high), F.lit(0)).when(enough & (ratio >= rest_low) & (ratio < rest_high), peeled)

    first = near.where((F.col("amount_drops") > dust) & F.col("account_rank").isNotNull())
    if seeds is not None:
        first = first.join(rank.orderBy("address").limit(seeds).select(F.col("address").alias("account")), "account", "left_semi")
    return _reported(_walked(first, step, ok, F.size("hops") >= F.when(F.col("remainders") > 0, rest_least).otherwise(least), longest), chains)


def edge_chains(edges: DataFrame, flags: DataFrame, low: float = 0.6, high: float = 0.95, least: int = 3, dust: int = 100, gap: int = 900, window_ms: int = 86_400_000, longest: int = 8, degree: int = 4, hub: int = 20, seeds: int | None = None, chains: int | None = None) -> DataFrame:
    """Chains over accumulated edges (HOP and close_ms): flagged accounts relay too, hops lie at most `gap` ledgers apart and the whole chain within window_ms.

    All edges count in the relays' degree. Hops without a ledger or time are not held against the limits.
    """
    t, rank = _marked(edges, flags)
    relay = _relays(t, _busy(t, hub), degree)
    step = relay.withColumn("peels", F.array().cast("array<struct<destination:string,amount_drops:bigint>>"))
    apart = F.coalesce(F.abs(F.col("way.ledger_seq") - F.col("in_seq")) > gap, F.lit(False))
    ok = lambda ratio, _: F.when((F.col("way.amount_drops") > dust) & ratio.between(low, high) & ~apart, F.lit(0))
    first = t.where((F.col("amount_drops") > dust) & F.col("account_rank").isNotNull())
    if seeds is not None:
        first = first.join(rank.orderBy("address").limit(seeds).select(F.col("address").alias("account")), "account", "left_semi")
    walked = _walked(first, step, ok, F.size("hops") >= least, longest)
    if "close_ms" in edges.columns:
        at = edges.where("close_ms is not null").groupBy("hash").agg(F.min("close_ms").alias("at"))
        ends = walked.select(F.array_join("path", ",").alias("sig"), F.explode("hops").alias("h")).select("sig", F.col("h.hash").alias("hash")).join(at, "hash").groupBy("sig").agg((F.max("at") - F.min("at")).alias("span"))
        walked = walked.withColumn("sig", F.array_join("path", ",")).join(ends.where(F.col("span") > window_ms), "sig", "left_anti").drop("sig")
    return _reported(walked, chains)


def owned(chains: DataFrame, members: DataFrame) -> DataFrame:
    """chains with `owner`: the cluster of the seed, else that of the first address of the path that has one; others are left out.

    members: (cluster, address); of an address in several clusters the first cluster by name counts.
    """
    home = members.groupBy("address").agg(F.min("cluster").alias("cluster"))
    at = chains.select("signature", F.posexplode("path").alias("pos", "address")).join(home, "address").groupBy("signature").agg(F.min_by("cluster", "pos").alias("owner"))
    return chains.join(at, "signature")


def folded(known: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """State chains (owner, signature, hops) after a fold of the found ones: of each owner the first `most` by signature; a chain found again replaces its older form."""
    both = known.select("owner", "signature", "hops", F.lit(0).alias("age")).unionByName(found.select("owner", "signature", "hops", F.lit(1).alias("age")))
    last = both.groupBy("owner", "signature").agg(F.max_by("hops", "age").alias("hops"))
    return last.withColumn("_n", F.row_number().over(Window.partitionBy("owner").orderBy("signature"))).where(F.col("_n") <= most).drop("_n")


def fold_chains(known: DataFrame, edges: DataFrame, flags: DataFrame, members: DataFrame, most: int, **limits) -> DataFrame:
    """State chains after a fold of the ones found over all state edges."""
    return folded(known, owned(edge_chains(edges, flags, **limits), members), most)

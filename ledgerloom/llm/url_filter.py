"""URL filter: list rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_batch

#: The labelled URL table (a fixed value): 1 is to be blocked.
LABELLED = [
    (1, "online-casino-royal.net/slots/jackpot"), (1, "www.casino4you.org/play/roulette"), (1, "win-big-casino.biz/bonus"), (1, "megawin-slots.com/spin"),
    (1, "poker-bets.info/join"), (1, "freebet-bonus.net/odds"), (1, "best-bets-today.com/free"), (1, "sportsbets-free.org/sign-up"),
    (1, "xxx-adult-videos.com/watch"), (1, "adult-dating-x.net/profiles"), (1, "hot-adult-cams.org/live"), (1, "porn-tube-x.biz/video"),
    (1, "sexy-escort-city.info/girls"), (1, "cheap-meds-pills.com/viagra"), (1, "buy-pills-cheap.org/order"), (1, "online-pharmacy-pills.biz/cialis"),
    (1, "spam-links.net/farm"), (1, "linkfarm-seo-spam.com/backlinks"), (1, "article-spam-farm.info/post"), (1, "ads-click-tracker.com/pixel"),
    (1, "adserver-track.net/banner"), (1, "popup-ads-network.biz/click"), (1, "track-ads-pixel.org/imp"), (1, "warez-crack-keys.net/download"),
    (1, "free-cracked-software.info/keygen"), (1, "payday-loan-fast.biz/apply"), (1, "win-free-iphone.info/claim"), (1, "lottery-winner-claim.com/prize"),
    (1, "replica-watches-cheap.com/buy"), (1, "weight-loss-miracle-pills.net/buy"),
    (0, "www.city-library.org/catalogue"), (0, "news.daily-herald.com/politics/election"), (0, "en.encyclopedia.org/wiki/history"), (0, "docs.python-guide.org/tutorial/functions"),
    (0, "blog.gardening-notes.net/tomatoes"), (0, "www.state-university.edu/research/physics"), (0, "recipes.kitchen-table.com/bread"), (0, "m.weather-report.net/forecast"),
    (0, "www.museum-of-art.org/exhibitions"), (0, "shop.bookstore.com/novels"), (0, "forum.bike-repair.net/thread"), (0, "www.health-ministry.gov/vaccination"),
    (0, "blog.travel-stories.org/es/madrid"), (0, "www.zeitung-heute.net/de/wirtschaft"), (0, "actualites.journal.net/fr/culture"), (0, "noticias.diario.net/es/deportes"),
    (0, "mathematics.lectures.edu/algebra"), (0, "www.football-club.com/fixtures"), (0, "open-source-project.org/download"), (0, "help.photo-editor.com/manual"),
    (0, "www.mountain-hikes.net/trails"), (0, "music-school.org/lessons/piano"), (0, "blog.teacher-corner.com/en/reading"), (0, "therapy-network.net/about"),
    (0, "www.history-thing.net/en/article"), (0, "thethread.blog/en/archive.html"), (0, "m.station-times.org/timetable/"), (0, "science.institute.edu/en/papers"),
    (0, "www.weather-station.org/de/karte"), (0, "cooking-with-children.net/fr/recettes"),
    (1, "casino-palace.example.org/en/21.html"), (1, "lucky-win.example.net/de/7"), (1, "spam-mill.example.net/en/318/"), (1, "link-farm.example.com/fr/52"),
    (1, "adult-zone.example.com/es/90.html"), (1, "x-videos.example.org/en/64/"), (1, "cheap-meds.example.com/de/15.html"), (1, "diet-pills.example.net/en/733"),
    (1, "ads-server.example.org/fr/11/"), (1, "click-track.example.net/en/402"), (1, "free-spins.example.org/es/8"), (1, "sure-bets.example.net/en/61.html"),
    (0, "thegarden.example.com/en/41.html"), (0, "blog.stationery.example.net/de/9"), (0, "www.northern.example.org/fr/230/"), (0, "m.ration.example.com/es/77.html"),
    (0, "thatched.example.net/en/5"), (0, "weather.example.org/en/812/"), (0, "blog.another.example.com/en/36.html"), (0, "www.nation.example.net/es/14"),
    (0, "threads.example.org/de/603.html"), (0, "m.therein.example.com/fr/99"), (0, "www.possible.example.net/en/270/"), (0, "oration.example.org/en/18"),
    (0, "nationship.example.net/en/6.html"), (0, "motion.example.net/fr/31/"), (0, "heather.example.com/de/58"), (0, "thousand.example.net/es/703.html"),
    (0, "english.example.net/en/440"), (0, "friendly.example.org/fr/12"), (0, "the-hand.example.com/es/2/"), (0, "old-station.example.net/de/19.html"),
    (0, "relationship.example.org/de/66"), (0, "withshe.example.com/en/150"), (0, "mother-tongue.example.net/es/8/"), (0, "another.example.com/fr/27.html"),
]

HASHED = 1 << 15
_NUMBER = re.compile(r"\d+")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty without ://, or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: str, path: str, orders=(3, 4, 5)) -> np.ndarray:
    """Hash buckets of the distinct n-grams of host and path, each marked with where it stands; a number counts as one 0."""
    host, path = _NUMBER.sub("0", host), _NUMBER.sub("0", path.lower())
    found = {zlib.crc32(f"{mark}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % HASHED for mark, s in (("h", f"^{host}$"), ("p", f"{path}$")) for n in orders for i in range(len(s) - n + 1)}
    return np.fromiter(sorted(found), np.int64, len(found))


def train(labelled=LABELLED, rounds: int = 1500, rate: float = 0.5, l2: float = 2e-4) -> np.ndarray:
    """Weights by full-batch gradient descent on length-normalized n-gram vectors; the last weight is the bias."""
    x = np.zeros((len(labelled), HASHED + 1))
    for k, (_, url) in enumerate(labelled):
        host, slash, path = url.partition("/")
        g = grams(host, slash + path)
        x[k, g] = 4 / np.sqrt(len(g))
        x[k, -1] = 1
    y = np.array([label for label, _ in labelled], float)
    used = np.flatnonzero(x.any(axis=0))
    z, w = x[:, used], np.zeros(len(used))
    for _ in range(rounds):
        w -= rate * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + l2 * w)
    out = np.zeros(HASHED + 1)
    out[used] = w
    return out


def score(weights: np.ndarray, host: str, path: str) -> float:
    g = grams(host, path)
    z = weights[-1] + (weights[g].sum() * 4 / np.sqrt(len(g)) if len(g) else 0)
    return float(1 / (1 + np.exp(-z)))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of every row.

    rules are (verdict, host, path) and a few by number: the list goes into the plan. A rule fits its host
    and all subdomains if the path starts with the rule's; the longest rule string wins (equal ones: block
    before allow). Without a rule the classifier decides: block from `threshold` on. Null urls and urls
    without :// have empty host and path and are judged by the classifier's bias. Repeated rows keep
    their rows; other columns are ignored.
    """
    weights = urls.sparkSession.sparkContext.broadcast(train())

    def make():
        w = weights.value

        def f(cols):
            return {"id": cols["id"], "host": cols["host"], "path": cols["path"], "score": [score(w, h, p) for h, p in zip(cols["host"].to_pylist(), cols["path"].to_pylist())]}

        return f

    kind = urls.schema[id_col].dataType.simpleString()
    rows = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = by_batch(rows, f"id {kind}, host string, path string, score double", make)
    rule = F.lit(None).cast("struct<text:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.struct(F.lit(host + path).alias("text"), F.lit(verdict).alias("verdict"))).otherwise(rule)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("r", rule).select(F.col("id").alias(id_col), "host", "path", F.col("r.text").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "score")

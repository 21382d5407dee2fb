"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every distinct URL is expanded into the expressions that a rule of the table could have: the last k labels
of its host with the first m characters of its path, for the pairs (k, m) that occur among the rules. An
expression meets a rule when 32 bits of their digests are equal (the join); full digests and then
precedence decide. URLs are judged once each: equal URLs are merged before the join, map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HOT_KEYS, cut, without

#: Rows of a rule table that may be broadcast: some 100 bytes each.
BROADCAST_RULES = 100_000
#: Beyond that, expressions of a hash prefix go to so many tasks, rules to each of them.
SALTS = 16
#: Shapes of rules (labels of the host, characters of the path) that are expanded in one pass.
SHAPES_AT_ONCE = 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """The rule that wins for each distinct ``url`` that any rule of (host, path, action) fits.

    The longest rule wins (characters of host and path), then the longer host, then block before allow.
    """
    rules = rules.where("host is not null and host <> '' and path is not null").select("host", "path", "action").distinct()
    shapes = rules.select(F.size(F.split("host", "\\.")).alias("k"), F.length("path").alias("m")).distinct()
    rules = rules.select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        "action",
        _digest(F.col("host"), F.col("path")).alias("digest"),
    ).withColumn("prefix", _prefix(F.col("digest")))
    small = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    # pairs of small numbers: as many as (labels of a host) times (lengths of a rule's path) at most
    shapes = sorted((r["k"], r["m"]) for r in shapes.collect())
    urls = urls.where("url is not null").select("url").distinct().withColumn("__host", host_of(F.col("url"))).withColumn("__path", path_of(F.col("url"))).where("__host <> ''")
    urls = urls.withColumn("__labels", F.split("__host", "\\."))
    found = None
    for i in range(0, len(shapes), SHAPES_AT_ONCE):
        fits = [
            F.when(
                (F.size("__labels") >= k) & (F.length("__path") >= m),
                _digest(F.array_join(F.slice("__labels", F.size("__labels") - k + 1, F.lit(k)), "."), F.substr(F.col("__path"), F.lit(1), F.lit(m))),
            )
            for k, m in shapes[i : i + SHAPES_AT_ONCE]
        ]
        wide = urls.select("url", F.explode(F.array_compact(F.array(*fits))).alias("own_digest")).withColumn("prefix", _prefix(F.col("own_digest")))
        if small:
            joined = wide.join(F.broadcast(rules), "prefix")
        else:
            salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = wide.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"])
        hit = joined.where("own_digest = digest").select("url", F.struct(F.length("rule").alias("length"), "host_length", (F.col("action") == "block").alias("blocks"), "rule", "action").alias("best"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).where("false")
    best = found.groupBy("url").agg(F.max("best").alias("best"))
    return best.select("url", "best.rule", "best.action")


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Each row of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    A null URL, or one without ``://``, has an empty host and path, and gets ``default``. Repeated rows are
    judged alike; an empty table of pages or of rules is no error. Input columns named like a result's are
    replaced. Rows without a URL, or with a very frequent one, get keys of their own in the join: they meet in no task.
    Distinct URLs and how often each occurs are written to the shared folder.
    """
    base = without(pages.withColumn("__url", F.col(url)), *(c for c in ("host", "path", "rule", "verdict") if c != url))
    counted = cut(base.where("__url is not null").groupBy(F.col("__url").alias("url")).agg(F.count("*").alias("n")), "urls")
    won = judge(counted.select("url"), rules, broadcast_rules)
    total = counted.agg(F.sum("n")).first()[0] or 0
    # a URL of more than one in HOT_KEYS rows is told apart by broadcast, and its rows meet in no task
    hot = counted.where(F.col("n") * HOT_KEYS > total).select("url")
    often = F.broadcast(hot.join(won, "url", "left").select(F.col("url").alias("__url"), F.struct("rule", F.col("action")).alias("__often")))
    base = base.join(often, "__url", "left")
    spread = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    base = base.withColumn("__key", F.when(F.col("__often").isNull(), F.col("__url"))).withColumn("__key", F.coalesce("__key", spread))
    out = base.join(won.select(F.col("url").alias("__key"), F.struct("rule", "action").alias("__won")), "__key", "left")
    out = out.withColumn("__won", F.coalesce("__often", "__won")).withColumn("rule", F.col("__won.rule"))
    out = out.withColumn("host", F.coalesce(host_of(F.col("__url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("__url")), F.lit("")))
    return out.withColumn("verdict", F.coalesce("__won.action", F.lit(default))).drop("__key", "__url", "__won", "__often")

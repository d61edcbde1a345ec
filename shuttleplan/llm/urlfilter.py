"""URL rules in a Bloom filter cascade.

Level 1 encodes the listed keys; level 2 those keys of the corpus that level 1 admits wrongly;
level 3 the listed keys that level 2 admits, and so on until nothing is admitted wrongly. A key of
the corpus is listed exactly if the first level that rejects it is an even one (or if it passes all
of an odd number of levels). Built over the corpus's complete key universe the answer is exact, and
pages are judged in one pass without a join.

Keys are (host suffix, path prefix) pairs; only the label counts and path lengths that some rule
has can match, so a url has few keys. Each level is a bit array kept as rows (word, bits) that
Spark aggregates. Level 1 has as many bits and hashes as leave no more wrongly admitted keys than there
are listed ones, however large the corpus (log2 of keys in the corpus per listed key), so every level's
size follows the listed keys alone: some 60 bits each at most. Beyond ``block_keys`` listed keys they are
dealt over several cascades by their hash, and the pages pass one after another.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize

HASHES, BITS_PER_KEY, MIN_BITS = 5, 8, 4096
#: listed keys of one verdict in one cascade; some 60 bits each are broadcast
BLOCK_KEYS = 2_000_000
#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_path(url: str | F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _keys(labels: list[int], lengths: list[int]) -> F.Column:
    """All (key hash pair, key) of a host and path that some rule could have."""
    part = F.split("host", r"\.")
    suffixes = [F.when(F.size(part) >= n, F.array_join(F.slice(part, F.greatest(F.size(part) - n + 1, F.lit(1)), n), ".")) for n in labels]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    return F.array_compact(F.array(*[F.concat(h, F.lit("\n"), p) for h in suffixes for p in prefixes]))


def _places(key: F.Column, level: int, bits: int, hashes: int) -> F.Column:
    """Places of a key at a level, by double hashing."""
    one, two = (F.pmod(F.xxhash64(F.lit(x), key), F.lit(1 << 50)) for x in (level, level + 1000))
    return F.array(*[F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)])


def _fill(keys: DataFrame, level: int, against: int) -> tuple[int, int, np.ndarray]:
    """(bits, hashes, bit array) of a level, sized for its keys and, on the first level, for the keys to tell them from."""
    n = max(1, keys.count())
    hashes = HASHES if level else max(HASHES, math.ceil(math.log2(max(1, against) / n + 1)))
    bits = max(MIN_BITS, math.ceil(max(BITS_PER_KEY, 1.45 * hashes) * n / 64) * 64)
    rows = (
        keys.select(F.explode(_places(F.col("key"), level, bits, hashes)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    )
    out = np.zeros(bits // 64, np.int64)
    table = rows.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits, hashes, out


def _admits(level: int, bits: int, hashes: int, words: np.ndarray):
    """Column function: does the level admit the key."""
    shared = words.tobytes()

    @F.pandas_udf("boolean")
    def admits(places):  # arrays of places
        import pandas as pd

        array, p = np.frombuffer(shared, np.int64), np.stack(places.to_numpy()) if len(places) else np.zeros((0, hashes), np.int64)
        return pd.Series(((array[p >> 6] >> (p & 63)) & 1).all(axis=1))

    return lambda key: admits(_places(key, level, bits, hashes))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> list[tuple[int, int, np.ndarray]]:
    """Levels over ``listed`` and ``universe`` (both distinct, column key)."""
    levels: list[tuple[int, int, np.ndarray]] = []
    inside, outside = listed, materialize(universe.join(listed, "key", "left_anti"))
    while len(levels) < max_levels:
        level = len(levels)
        levels.append(_fill(inside, level, 0 if level else outside.count()))
        wrong = materialize(outside.where(_admits(level, *levels[-1])(F.col("key"))))
        if wrong.isEmpty():
            return levels
        inside, outside = wrong, inside
    raise RuntimeError("the cascade did not end; raise max_levels")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule and verdict.

    ``rules`` has host, path, verdict. A rule fits its host and every subdomain when the url's path
    starts with the rule's; of those that fit the longest (host and path together) wins. Urls that no
    rule fits, null ones and those without ``://`` get ``default`` and a null rule. Of rules with the
    same host and path the one with the least verdict counts; rules with a null are left out; no
    rules leave every url at ``default``. Repeated pages are judged alike, other columns pass through.
    """
    clash = [c for c in pages.columns if c in ("host", "path", "rule", "verdict", "keys", "own", "best")]
    host, path = host_path("url")
    base = pages.drop(*clash).withColumns({"host": host, "path": path})
    listed = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.concat("host", F.lit("\n"), "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.size(F.split(F.first("host"), r"\.")).alias("labels"), F.length(F.first("path")).alias("length"))
    listed = materialize(listed)
    shape = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths"), F.sort_array(F.collect_set("verdict")).alias("verdicts")).first()
    if not shape["n"]:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = base.withColumn("keys", _keys(shape["labels"], shape["lengths"]))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    universe, judged = materialize(universe), keyed.withColumn("best", F.lit(None).cast("struct<n: int, key: string, v: string>"))
    blocks = -(-shape["n"] // block_keys)
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("key"), F.lit(blocks)) == b
        own = F.col("keys") if blocks == 1 else F.filter("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(blocks)) == b)
        judged, fits = judged.withColumn("own", own), [F.array("best")]
        for v in shape["verdicts"]:
            levels = build_cascade(listed.where((F.col("verdict") == v) & mine).select("key"), universe.where(mine))
            both = F.arrays_zip(F.col("own").alias("key"), _member_array(levels)("own").alias("listed"))
            fits.append(F.transform(F.filter(both, lambda x: x["listed"]), _ranked(F.lit(v))))
        judged = judged.withColumn("best", F.array_max(F.concat(*fits))).drop("own")
        judged = materialize(judged) if b < blocks - 1 else judged
    judged = judged.drop("keys")
    return judged.withColumns({"rule": F.translate("best.key", "\n", ""), "verdict": F.coalesce("best.v", F.lit(default))}).drop("best")


def _ranked(verdict: F.Column):
    return lambda x: F.struct(F.length(x["key"]).alias("n"), x["key"].alias("key"), verdict.alias("v"))


def _member_array(levels: list[tuple[int, int, np.ndarray]]):
    """Column function: for an array of keys, which are listed."""
    hashes, arrays = [h for _, h, _ in levels], [a.tobytes() for _, _, a in levels]
    ends = np.cumsum(hashes).tolist()

    @F.pandas_udf("array<boolean>")
    def member(places):  # per row: the places of all levels, key after key
        import pandas as pd

        counts = places.map(len).to_numpy() // ends[-1] if len(places) else np.zeros(0, int)
        flat = np.concatenate([np.asarray(x, np.int64) for x in places]) if counts.sum() else np.zeros(0, np.int64)
        p = flat.reshape(-1, ends[-1])
        answer, open_ = np.full(len(p), len(arrays) % 2 == 1), np.ones(len(p), bool)
        for i, raw in enumerate(arrays):
            array, own = np.frombuffer(raw, np.int64), p[:, ends[i] - hashes[i] : ends[i]]
            ok = ((array[own >> 6] >> (own & 63)) & 1).all(axis=1)
            answer[open_ & ~ok] = i % 2 == 1
            open_ &= ok
        return pd.Series(np.split(answer, np.cumsum(counts)[:-1]) if len(counts) else [], dtype=object)

    def over(keys: str) -> F.Column:
        return member(F.flatten(F.transform(keys, lambda k: F.flatten(F.array(*[_places(k, i, b, h) for i, (b, h, _) in enumerate(levels)])))))

    return over


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), h as (
  select page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from p
), r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select *, row_number() over (partition by page_id order by case when rh is null then 0 else length(rh) + length(rp) end desc) as k
  from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select page_id, host, path, rh || rp as rule, coalesce(v, 'allow') as verdict from m where k = 1
"""

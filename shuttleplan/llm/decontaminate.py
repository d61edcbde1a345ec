"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the least is kept as a fingerprint. Two texts that
share ``window`` words share ``window - k + 1`` k-grams in a row, so they share the fingerprint
chosen there: joining the fingerprints of training and benchmark texts finds every shared span of
that length, and each hit is extended and verified word for word with 128-bit window hashes.
Items shorter than a window are looked up as one window of their own length.

The benchmark's index is broadcast in blocks of items; the block count follows from the measured
size of the benchmark, so no block passes ``max_index_words`` (a single item may, being one row).
The documents are never shuffled; with several blocks only hits are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

WINDOW, K = 13, 5
HITS = "n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<string>"


class Index:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, k: int):
        self.ids, self.window, self.k = ids, window, k
        w = W.words(*W.utf8(pa.array(texts, pa.string())), kind=W.ALNUM, fold=W.LOWER)
        n, size = len(w.h), np.diff(w.ptr)
        self.prints = np.unique(w_prints[1]) if len((w_prints := fingerprints(w, window, k))[1]) else np.zeros(0, np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        one, two = W.Sequences(w.h), W.Sequences(w.h, W.P_TWO)
        lengths = {int(x) for x in size if 0 < x < window} | ({window} if (size >= window).any() else set())
        doc = w.doc
        for m in sorted(lengths):
            if m == window:
                at = np.flatnonzero(W.gram_starts(w.ptr, m, n))
            else:
                at = w.ptr[:-1][size == m]
            f, g, owner = one.of(at, at + m), two.of(at, at + m), doc[at]
            order = np.lexsort((owner, g, f))
            self.tables[m] = (f[order], g[order], owner[order])

    def owners(self, m: int, f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in f, item) for every item whose window of m words equals (f, g)."""
        tf, tg, owner = self.tables[m]
        lo, hi = np.searchsorted(tf, f, "left"), np.searchsorted(tf, f, "right")
        count = hi - lo
        place = np.repeat(np.arange(len(f)), count)
        entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = tg[entry] == g[place]
        return place[same], owner[entry[same]]


def fingerprints(w: W.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the k-grams that are least in some window, the leftmost on ties."""
    n, span = len(w.h), window - k + 1
    at = np.flatnonzero(W.gram_starts(w.ptr, window, n))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    grams = W.Sequences(w.h).grams(k)
    best, least = at.copy(), grams[at]
    for step in range(1, span):
        other = grams[at + step]
        less = other < least
        least = np.where(less, other, least)
        best = np.where(less, at + step, best)
    best = np.unique(best)
    return best, grams[best]


def hits(w: W.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of every occurrence of a window of the index."""
    n, found = len(w.h), []
    one, two = W.Sequences(w.h), W.Sequences(w.h, W.P_TWO)
    for m in index.tables:
        if m == index.window:
            at, prints = fingerprints(w, index.window, index.k)
            at = at[W.lookup(index.prints, prints) >= 0]
            reach = W.covered(n, np.maximum(at - (index.window - index.k), 0), at + 1)
            at = np.flatnonzero(reach & W.gram_starts(w.ptr, m, n))
        else:
            at = np.flatnonzero(W.gram_starts(w.ptr, m, n))
            at = at[W.lookup(index.tables[m][0], one.of(at, at + m)) >= 0]
        place, item = index.owners(m, one.of(at, at + m), two.of(at, at + m))
        found.append((at[place], np.full(len(place), m), item))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spans_of(mask: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2] - lo, edge[1::2] - lo


def _scan(index, text: int) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            data, off = W.utf8(batch.column(text))
            counts, spans, items = [], [], []
            for i, j in W.runs(off):
                w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i], W.ALNUM, W.LOWER)
                at, m, item = hits(w, block)
                doc, n = w.doc, len(w.h)
                inside = W.covered(n, at, at + m)
                counts += np.diff(w.ptr).tolist()
                own = np.unique(np.stack([doc[at], item]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                got = np.bincount(own[0], minlength=j - i)
                k = 0
                for d in range(j - i):
                    if not got[d]:
                        spans.append([])
                        items.append([])
                        continue
                    a, b = int(w.ptr[d]), int(w.ptr[d + 1])
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(*spans_of(inside[a:b], 0), strict=True)])
                    items.append([block.ids[x] for x in own[1][k : k + got[d]]])
                    k += got[d]
            fields = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            kept = [c for c in batch.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *fields], names=[*kept, "n_words", "spans", "item_ids"])

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, k: int = K, max_index_words: int = 2_000_000) -> DataFrame:
    """One row per document: the columns ``keep`` (default doc_id), n_words, spans, item_ids.

    ``docs`` has ``text``; ``benchmark`` has ``item_id`` and ``text``. ``spans`` are the word ranges
    (end exclusive, sorted, disjoint) inside an occurrence of a window of an item; ``item_ids`` the
    distinct items, sorted as strings. Words: A-Z lower-cased, runs of ASCII letters and digits and
    non-ASCII characters. Null or wordless text: 0 words and no hit; benchmark rows without an id
    or a word are left out; repeated items and repeated document rows each count on their own; an
    empty benchmark hits nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (2 * max_index_words)))
    text = keep.index("text") if "text" in keep else len(keep)  # texts go to Python once, and come back only if kept
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col("text").alias("t")] * (text == len(keep)))
    schema = ", ".join(f"k{i} {t}" for i, t in enumerate(docs.select(*keep).schema[c].dataType.simpleString() for c in keep))
    outs = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Index([r["item_id"] for r in mine], [r["text"] for r in mine], window, k))
        if blocks > 1:
            rows_b = rows.withColumn("r", F.xxhash64(*rows.columns))
        else:
            rows_b = rows
        outs.append(rows_b.mapInArrow(W.tidied(_scan(shared, text)), f"{schema}, {'r bigint, ' if blocks > 1 else ''}{HITS}"))
    if blocks == 1:
        out = outs[0]
    else:
        out = _merge(outs, len(keep))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def _merge(outs: list[DataFrame], n: int) -> DataFrame:
    """Union of the hits of several blocks. Rows equal in every column are alike in their hits too."""
    base = outs[0].groupBy(*[f"k{i}" for i in range(n)], "r").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    every = outs[0]
    for x in outs[1:]:
        every = every.union(x)
    found = every.where("size(item_ids) > 0").groupBy("r").agg(F.flatten(F.collect_set("spans")).alias("s"), F.flatten(F.collect_set("item_ids")).alias("item_ids"))
    ordered = F.array_sort("s")
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    merged = F.aggregate(
        ordered,
        F.array(start),
        lambda acc, x: F.when(
            F.element_at(acc, -1)["end"] >= x["start"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    joined = base.join(found, "r", "left").withColumn("spans", F.when(F.col("s").isNull(), F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.slice(merged, 2, F.greatest(F.size("s"), F.lit(1)))))
    joined = joined.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return joined.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("i", "copies", "r", "s")


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def contaminated(hit: str = "n_hit", total: str = "n_words") -> F.Column:
    """At least a twentieth of the words."""
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(total))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )

"""Near-duplicate documents: a prefix-tree join of word n-gram sets under one global order.

Order. Every n-gram is counted over all documents in hash buckets, whose number follows that of the n-grams (``SHARE`` a
bucket, up to 2 to the power of ``MOST_BITS`` buckets), so that rare ones are told from frequent ones in a large corpus as in a small one; an element of a
set is the frequency level of its bucket in the top byte and 56 bits of its hash below, so numeric order is
one global order, rarest first. A set is the path of its elements in that order.

Partitions. Sets with similarity t at least share an element among the first n - ceil(t n) + 1 of both, so
no link is lost if each set goes to the partitions of those elements, with its size and the element's
place: of the first element that two linked sets share, as many as they need must be left in both. As
the elements are the rarest ones, most partitions hold one set and are left out; the others stay small,
hot elements standing last on every path.

Join. The sets of a partition are stored in a prefix tree (in lexicographic order of paths, which walks it
depth first) and a pivot's set is run through it: overlap along a shared path is counted once, and a subtree
is left as soon as the overlap so far plus what may remain cannot reach the threshold. The least set of a
partition is its first pivot, so work is linear in a family of copies, and large trees are split (``TREE``).

Components. Linked sets are united. A large partition whose sets ended in different components elects another
pivot from outside the first component, for a few rounds; then all that is still apart in any partition goes
through the trees too, where sizes, places and parity sketches of the sets (as wide as large sets need) do not rule a link out. Those pairs
are found in cells of bounded size (``CELL``); a partition beyond ``BLOCK`` sets is cut into pairs of blocks.
All pairs of different texts that link are therefore united, directly or through others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.llm import wordhash as W
from shuttleplan.operators.components import connected_components

GRAM, NUM, DEN = 3, 9, 10
SKETCH = 256
BITS = [f"s{i}" for i in range(SKETCH // 64)]
#: members of a pivot in one tree
TREE = 256
#: rounds that elect further pivots in partitions of more than LARGE sets
ROUNDS, LARGE = 2, 32
#: shingles a bucket of the global order; least and most buckets, and buckets counted as one group (binary logarithms); levels to a doubling
SHARE, LEAST_BITS, MOST_BITS, GROUP_BITS, FINE = 16, 16, 24, 14, 6
#: sets of a partition in one block; rows of one cell; pairs looked at at once in a cell
BLOCK, CELL, PAIRS = 4096, 200_000, 1 << 20


class Threshold:
    """Exact integer forms of similarity >= num / den."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den

    def apart(self, total: np.ndarray | int):
        """Elements in which two linked sets of this total size differ at most."""
        return total * (self.den - self.num) // (self.den + self.num)

    def told(self, n):
        """Whether the short sketch of a set of n elements tells anything: those of unlike large sets differ in half of the bits, which linked ones may too."""
        return 2 * n * (self.den - self.num) < (self.den + self.num) * SKETCH // 2

    def overlap(self, total: int) -> int:
        """Least common elements of linked sets with this total size."""
        return -(-self.num * total // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """First elements of which linked sets share one; 0 where only an equal set can link."""
        return np.where(n * (self.den - self.num) >= self.num, n + 1 + (-self.num * n) // self.den, 0)


def in_order(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Elements of the global order: level of the hash's bucket, then the hash."""
    shift = np.uint64(64 - (len(levels).bit_length() - 1))
    return (levels[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def shingle_sets(w: W.Words, gram: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of every document, offsets): hashes, or elements of the global order."""
    n, docs = len(w.h), len(w.ptr) - 1
    seq = W.Sequences(w.h)
    at = np.flatnonzero(W.gram_starts(w.ptr, gram, n))
    size = np.diff(w.ptr)
    short = np.flatnonzero((size > 0) & (size < gram))
    h = np.concatenate([seq.of(at, at + gram), seq.of(w.ptr[short], w.ptr[short + 1])])
    d = np.concatenate([w.doc[at], short])
    if levels is not None:
        h = in_order(h, levels)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def _sets(column: pa.Array, gram: int, levels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, off = W.utf8(column)
    for i, j in W.runs(off):
        h, ptr = shingle_sets(W.words(data[off[i] : off[j]], off[i : j + 1] - off[i], W.PLAIN, W.LOWER), gram, levels)
        yield i, h, ptr


def _sum(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=c[1:])
    return (c[ptr[1:]] - c[ptr[:-1]]).view(np.int64)


def wide_sketches(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of every set, all words): parity sketches of one to two bits an element for sets of more than ``SKETCH`` elements, else none.

    An element's bit is the lower part of its hash, so a sketch twice as wide is folded by XOR of its halves.
    """
    size = np.diff(ptr)
    bits = np.where(size > SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
    start, d = np.cumsum(bits) - bits, np.repeat(np.arange(len(size)), size)
    long = bits[d] > 0
    d = d[long]
    at = start[d] + (h[long] & (bits[d] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool)
    return bits // 64, np.packbits(odd).view(np.int64)


def _describe(gram: int):
    """doc_id, text -> size, 128-bit set hash, parity sketch, and a wide one for sets of more than ``SKETCH`` elements."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sketch = [], [], [], [np.zeros((0, SKETCH // 64), np.int64)]
            much, wide = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for _, h, ptr in _sets(batch.column(1), gram):
                docs = len(ptr) - 1
                n.append(np.diff(ptr))
                one.append(_sum(W.mix(h ^ np.uint64(W.P_ONE)), ptr))
                two.append(_sum(W.mix(h ^ np.uint64(W.P_TWO)), ptr))
                d = np.repeat(np.arange(docs), np.diff(ptr))
                bit = (h >> np.uint64(56)).astype(np.int64)
                odd = (np.bincount(d * SKETCH + bit, minlength=docs * SKETCH) & 1).astype(bool).reshape(docs, SKETCH)
                sketch.append(np.packbits(odd, axis=1).view(np.int64))
                words, bits = wide_sketches(h, ptr)
                much.append(words)
                wide.append(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(much)).astype(np.int32)), pa.array(np.concatenate(wide)))
            cols = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (n, one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *[pa.array(x) for x in np.concatenate(sketch).T], lists], names=["doc_id", "n", "f", "g", *BITS, "wide"])

    return describe


def bucket_bits(shingles: int) -> int:
    """Binary logarithm of the number of buckets for so many shingles."""
    return min(MOST_BITS, max(LEAST_BITS, (max(0, shingles - 1) // SHARE).bit_length()))


def _tally(gram: int, bits: int):
    """(part, at): the buckets of a task's shingles, part by part, each as 16-bit places in order and as often as it occurs."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, h, _ in _sets(batch.column(0), gram):
                np.add.at(n, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for part, own in enumerate(n.reshape(-1, 1 << GROUP_BITS)):
            if own.any():
                at = np.repeat(np.arange(1 << GROUP_BITS, dtype=np.uint16), own)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.tobytes()], pa.binary())], names=["part", "at"])

    return tally


def _levels(table: pa.Table) -> pa.Table:
    """(part, level): the levels of a part's buckets, one byte each."""
    n = np.zeros(1 << GROUP_BITS, np.int64)
    for chunk in table["at"].chunks:
        for at in chunk:
            n += np.bincount(np.frombuffer(at.as_buffer(), np.uint16), minlength=1 << GROUP_BITS)
    level = np.minimum(np.ceil(FINE * np.log2(n + 1)), 255).astype(np.uint8)
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})


def _prefixes(gram: int, t: Threshold, order: bytes):
    """(e, doc_id, f, n, at) for the prefix elements of every set: f tells sets apart, n elements, e at that place; equal sets of a batch send once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(order, np.uint8)
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for i, h, ptr in _sets(batch.column(1), gram, levels):
                size = np.diff(ptr)
                f = _sum(W.mix(h ^ np.uint64(W.P_ONE)), ptr)
                rank = np.lexsort((ids[i : i + len(size)], f))
                lead = np.zeros(len(size), bool)
                lead[rank] = np.concatenate(([True], f[rank][1:] != f[rank][:-1]))
                much = np.where(lead, t.prefix(size), 0)
                doc = np.repeat(np.arange(len(size)), much)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(much) - much, much)
                e = h[at + ptr[:-1][doc]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e, ids[i + doc], f[doc], size[doc].astype(np.int32), at.astype(np.int32))], names=["e", "doc_id", "f", "n", "at"])

    return send


def tree_overlaps(query: np.ndarray, members: list[np.ndarray], t: Threshold) -> np.ndarray:
    """Overlap of ``query`` with every member that may link with it, -1 where a bound ruled it out.

    All are paths in the global order; sorted lexicographically the members are a depth-first walk
    of their prefix tree. ``path`` holds the overlap along the current path, of which the next member reuses the part
    that it shares; ``dead`` is the depth at which the current subtree was left.
    """
    out = np.full(len(members), -1, np.int64)
    order = sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())
    path, last, dead, step, q = np.zeros(1, np.int64), np.zeros(0, np.uint64), None, 64, len(query)
    for i in order:
        own = members[i]
        m, k = len(own), min(len(own), len(last))
        diff = np.flatnonzero(own[:k] != last[:k])
        common = int(diff[0]) if len(diff) else k
        last = own
        need = t.overlap(m + q)
        if dead is not None and common >= dead[0] and dead[1] + min(m - dead[0], dead[2]) < need:
            path = path[: common + 1]
            continue
        dead = None
        path = path[: min(common, len(path) - 1) + 1]
        at = len(path) - 1
        while at < m:
            part = own[at : at + step]
            path = np.concatenate([path, path[-1] + np.cumsum(W.lookup(query, part) >= 0)])
            at += len(part)
            left = q - int(np.searchsorted(query, part[-1], "right"))
            if path[-1] + min(m - at, left) < need:
                dead = (at, int(path[-1]), left)
                break
        if at >= m and path[-1] >= need:
            out[i] = path[-1]
    return out


def _walk(gram: int, t: Threshold, order: bytes):
    """Rows (p, x, salt, text) of a pivot and a tree of its members -> (p, x, overlap), -1 for those that do not link."""

    def walk(table: pa.Table) -> pa.Table:
        levels = np.frombuffer(order, np.uint8)
        p = table["p"][0].as_py()
        x = table["x"].to_pylist()
        sets: list[np.ndarray] = []
        for _, h, ptr in _sets(table["text"].cast(pa.large_string()).combine_chunks(), gram, levels):
            sets += [h[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        q = x.index(p)
        others = [i for i in range(len(x)) if x[i] != p]
        both = tree_overlaps(sets[q], [sets[i] for i in others], t)
        return pa.table({"p": pa.array([p] * len(others), pa.int64()), "x": pa.array([x[i] for i in others], pa.int64()), "both": both})

    return walk


def _apart(t: Threshold):
    """Pairs of a cell's sets that share a partition and may link, from different components."""

    def apart(table: pa.Table) -> pa.Table:
        x, c, n, at, e, lo, hi, own = (table[k].to_numpy() for k in ("x", "c", "n", "at", "e", "lo", "hi", "own"))
        order = np.lexsort((n, hi, lo, e))
        x, c, n, at, own = (v[order] for v in (x, c, n.astype(np.int64), at.astype(np.int64), own))
        key = np.stack([v[order] for v in (e, lo, hi)])
        bits = np.stack([table[k].to_numpy()[order].view(np.uint64) for k in BITS], axis=1)  # counting bits takes the absolute value of signed numbers
        full = ~t.told(n)
        group = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0)))) if len(x) else np.zeros(0, np.int64)
        across = (key[1] != key[2]) if len(x) else np.zeros(0, bool)
        # sorted by size in a partition, the sets that are not too large for one follow it
        many = np.searchsorted((group << 40) + n, (group << 40) + n * t.den // t.num, "right") - np.arange(len(x)) - 1
        ends, found, i = np.cumsum(many), [np.zeros((0, 2), np.int64)], 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            u = np.repeat(np.arange(i, j), many[i:j])
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j])
            need = -(-t.num * (n[u] + n[v]) // (t.num + t.den))
            ok = (c[u] != c[v]) & (np.minimum(n[u] - at[u], n[v] - at[v]) >= need) & (~across[u] | (own[u] != own[v]))
            u, v = u[ok], v[ok]
            ok = full[u] | full[v] | (np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1) <= t.apart(n[u] + n[v]))
            u, v = x[u[ok]], x[v[ok]]
            found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0))
            i = j
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"p": out[:, 0], "x": out[:, 1]})

    return apart


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN):
        self.gram, self.t = gram, Threshold(num, den)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        rows = self.docs.mapInArrow(W.tidied(_describe(gram)), "doc_id bigint, n bigint, f bigint, g bigint, " + ", ".join(f"{b} bigint" for b in BITS) + ", wide array<bigint>")
        self.sets = materialize(rows)
        groups = self.sets.where("n > 0 and doc_id is not null").groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        self.groups = materialize(groups)
        self.reps = materialize(self.sets.where("n > 0").join(self.groups.select("n", "f", "g", F.col("rep").alias("doc_id")), ["n", "f", "g", "doc_id"]).select("doc_id", "n", *BITS, "wide").dropDuplicates(["doc_id"]))

    @functools.cached_property
    def order(self) -> bytes:
        """The level of every bucket, ``FINE`` times the binary logarithm of its count: one byte a bucket."""
        bits = bucket_bits(self.sets.agg(F.sum("n")).first()[0] or 0)
        parts = self.docs.select("text").mapInArrow(W.tidied(_tally(self.gram, bits)), "part int, at binary")
        got = parts.groupBy("part").applyInArrow(_levels, "part int, level binary").toArrow()
        levels = np.zeros((1 << bits - GROUP_BITS, 1 << GROUP_BITS), np.uint8)
        for part, level in zip(got["part"].to_pylist(), got["level"].to_pylist(), strict=True):
            levels[part] = np.frombuffer(level, np.uint8)
        return levels.tobytes()

    def candidates(self) -> DataFrame:
        """(p, x, w): edges from the sets of a partition to its least one, between representatives; the partitions are kept beside."""
        sent = self.docs.where("doc_id is not null").mapInArrow(W.tidied(_prefixes(self.gram, self.t, self.order)), "e bigint, doc_id bigint, f bigint, n int, at int")
        sent = materialize(sent)
        shared = sent.groupBy("e").agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low <> high").select("e")
        rep_of = self.sets.where("n > 0").join(self.groups, ["n", "f", "g"]).select("doc_id", "rep").distinct()
        own = sent.join(shared, "e").select("e", "doc_id", "n", "at").join(rep_of, "doc_id").select("e", F.col("rep").alias("x"), "n", "at").distinct()
        own = materialize(own)
        firsts = own.groupBy("e").agg(F.min(F.struct("x", "n", "at")).alias("u"), F.count("*").alias("m")).where("m > 1")
        self.parts = materialize(own.join(firsts, "e"))
        edges = self.parts.where("x <> u.x").where(self._meet("u.n", "u.at", "n", "at"))
        return self.possible(edges.groupBy(F.least("u.x", "x").alias("p"), F.greatest("u.x", "x").alias("x")).agg(F.count("*").alias("w")))

    def _meet(self, n: str, at: str, m: str, to: str) -> Column:
        """Sets of n and m elements may link if these places hold the first element that they share."""
        t = self.t
        left, total = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)), F.col(n) + F.col(m)
        return (t.den * F.least(n, m) >= t.num * F.greatest(n, m)) & ((t.num + t.den) * left.cast("bigint") >= t.num * total)

    def possible(self, edges: DataFrame) -> DataFrame:
        """Edges that sizes and sketches do not rule out: sketches differ in no more bits than sets in elements."""
        t = self.t
        a, b = (self.reps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{c}{k}") for c in BITS]) for k in "px")
        both = edges.join(a, "p").join(b, "x").where(t.den * F.least("np", "nx") >= t.num * F.greatest("np", "nx"))
        apart = sum((F.bit_count(F.col(f"{c}p").bitwiseXOR(F.col(f"{c}x"))) for c in BITS), F.lit(0))
        return self._close(both.where(apart * (t.den + t.num) <= (t.den - t.num) * (F.col("np") + F.col("nx"))).select("p", "x", *[c for c in edges.columns if c not in ("p", "x")]))

    def _close(self, edges: DataFrame) -> DataFrame:
        """Edges that the wide sketches do not rule out; those of large sets still tell unlike ones apart where short sketches are full."""
        t = self.t
        a, b = (self.reps.where(F.col("n") > SKETCH).select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "px")
        both = edges.join(a, "p", "left").join(b, "x", "left")
        least = F.least(F.size("wp"), F.size("wx"))
        differ = F.aggregate(F.zip_with(self._folded("wp", least), self._folded("wx", least), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
        out = F.col("wp").isNotNull() & F.col("wx").isNotNull() & (F.greatest(F.size("wp"), F.size("wx")) <= 2 * least)
        return both.where(~out | (differ * (t.den + t.num) <= (t.den - t.num) * (F.col("np") + F.col("nx")))).select(*edges.columns)

    @staticmethod
    def _folded(c: str, words: Column) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(c) > words, halves).otherwise(F.col(c))

    def walked(self, edges: DataFrame) -> DataFrame:
        """(p, x, both): overlap of each edge's sets by the trees of its pivot, -1 where a bound showed that they do not link."""
        edges = materialize(edges.select("p", "x"))
        need = edges.select(F.col("p").alias("doc_id")).union(edges.select("x")).distinct()
        texts = materialize(self.docs.join(need, "doc_id").dropDuplicates(["doc_id"]))
        trees = edges.groupBy("p").agg(F.count("*").alias("m")).select("p", F.ceil(F.col("m") / TREE).cast("int").alias("salts"))
        members = edges.join(trees, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"))
        pivots = trees.select("p", F.col("p").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rows = members.union(pivots).join(texts.withColumnRenamed("doc_id", "x"), "x").select("p", "x", "salt", "text")
        return rows.groupBy("p", "salt").applyInArrow(_walk(self.gram, self.t, self.order), "p bigint, x bigint, both bigint")

    def components(self) -> DataFrame:
        """(rep, component) of the representatives that link with another."""
        edges = materialize(self.candidates())
        best = edges.groupBy("x").agg(F.max(F.struct(F.col("w"), (-F.col("p")).alias("q"))).alias("m")).select((-F.col("m.q")).alias("p"), "x")
        seen = materialize(self.walked(best))
        comp = self._united(seen)
        seen, comp, _ = self._grown(self._cross(edges.join(seen, ["p", "x"], "left_anti"), comp), seen, comp)
        for k in range(ROUNDS):
            seen, comp, found = self._grown(self._elected(seen, comp, k), seen, comp)
            if not found:
                break
        return self._grown(self._rest(seen, comp), seen, comp)[1]

    def _grown(self, pairs: DataFrame, seen: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """What is seen and united once these pairs are verified, and whether any of them links."""
        pairs = materialize(pairs.select("p", "x"))
        if pairs.isEmpty():
            return seen, comp, False
        more = materialize(self.walked(pairs))
        seen, found = seen.unionByName(more), not more.where("both >= 0").isEmpty()
        return seen, self._united(seen) if found else comp, found

    def _united(self, seen: DataFrame) -> DataFrame:
        return materialize(connected_components(seen.where("both >= 0"), "p", "x"))

    def _cross(self, edges: DataFrame, comp: DataFrame) -> DataFrame:
        """Edges whose ends are not in one component, with the components (a lone node is its own)."""
        out = edges.join(comp.select(F.col("node").alias("p"), F.col("component").alias("cp")), "p", "left").join(comp.select(F.col("node").alias("x"), F.col("component").alias("c")), "x", "left")
        return out.withColumns({"cp": F.coalesce("cp", "p"), "c": F.coalesce("c", "x")}).where("cp <> c")

    def _mixed(self, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sets of partitions of more than LARGE that are not all in one component, with the partition's first pivot; those of them that are linked, with their component c."""
        own = self.parts.where(F.col("m") > LARGE).select("e", "x", "n", "at", "m", F.col("u.x").alias("first"))
        linked = own.join(comp.select(F.col("node").alias("x"), F.col("component").alias("c")), "x")
        whole = linked.groupBy("e").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k"), F.min("m").alias("m")).where("least = most and k = m").select("e")
        return own.join(whole, "e", "left_anti"), linked.join(whole, "e", "left_anti")

    def _elected(self, seen: DataFrame, comp: DataFrame, k: int) -> DataFrame:
        """Edges from the sets of every large mixed partition to one from outside its first component, drawn anew in each round."""
        own, linked = self._mixed(comp)
        inside = linked.join(linked.groupBy("e").agg(F.min("c").alias("c")), ["e", "c"]).select("e", "x")
        outside = own.where("x <> first").join(inside, ["e", "x"], "left_anti")
        draw = outside.groupBy("e").agg(F.min(F.struct(F.xxhash64("x", F.lit(k)).alias("h"), "x", "n", "at")).alias("u"))
        pairs = own.join(draw, "e").where("x <> u.x").where(self._meet("u.n", "u.at", "n", "at"))
        edges = self.possible(pairs.select(F.least("x", "u.x").alias("p"), F.greatest("x", "u.x").alias("x")).distinct())
        return self._cross(edges, comp).select("p", "x").join(seen, ["p", "x"], "left_anti")

    def _rest(self, seen: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs of sets that share any mixed partition and may link; small partitions are looked at whether mixed or not."""
        columns = ["e", "x", "n", "at", "m"]
        own = self.parts.where((F.col("m") > 2) & (F.col("m") <= LARGE)).select(columns).unionByName(self._mixed(comp)[0].select(columns))
        cells = -(-own.count() // CELL) or 1
        told = [F.when(self.t.told(F.col("n")), F.col(b)).otherwise(0).alias(b) for b in BITS]
        sets = self.reps.select(F.col("doc_id").alias("x"), *told).join(comp.select(F.col("node").alias("x"), F.col("component").alias("c")), "x", "left").withColumn("c", F.coalesce("c", "x"))
        own = own.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        own = own.withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = own.join(sets, "x").select("e", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "own", "x", "c", "n", "at", *BITS)
        cell = F.pmod(F.xxhash64("e", "lo", "hi"), F.lit(cells))
        pairs = rows.withColumn("cell", cell).groupBy("cell").applyInArrow(_apart(self.t), "p bigint, x bigint").distinct()
        return self._close(pairs.join(seen, ["p", "x"], "left_anti"))


def near_duplicates(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs`` with a doc_id.

    Sets are distinct ``gram``-word shingles of A-Z lower-cased words; shorter texts are one shingle,
    null or blank ones none, and those link with nothing. Two documents link when their similarity is
    ``num / den`` at least. component_id is the least doc_id that links reach. Rows with a null doc_id
    keep their size and get a null component. Rows that share a doc_id are one node; if their texts
    differ, each equal set is found, further links by one of the texts. No rows give no rows.
    """
    join = Join(docs, gram, num, den)
    comp = join.components()
    groups = join.groups.join(comp, F.col("rep") == F.col("node"), "left").select("n", "f", "g", F.coalesce("component", "rep").alias("component_id"))
    out = join.sets.join(groups, ["n", "f", "g"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

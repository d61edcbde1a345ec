"""Removal of long repeated word sequences by recompression.

Texts are parsed bottom-up: first runs of one word, then, round after round, pairs of neighbours,
are replaced by symbols whose names are hashes of their parts, so names agree over the whole corpus
without any exchange. A pair is joined if its first symbol's name falls into the left half of the
round's alphabet and the second's into the right half; whether a symbol forms therefore depends on a
short stretch of words only, its determining stretch. If a window of words holds that stretch,
every equal window holds the same symbol at the same place: equal windows agree on their interior
symbols. The highest symbol whose stretch a window holds (the leftmost of them) is its anchor.

Three rounds of messages run between chunks of documents and buckets of hashes:

1. anchors by name: which names occur at more than one place of the corpus;
2. windows with such an anchor, as 96-bit fingerprints with their first place in the chunk: which
   fingerprints repeat, and which chunk holds the first place;
3. every chunk marks the words of repeated windows but the first, and writes what is left.

A chunk sends each name or fingerprint once, however often it occurs there, so a text that a third
of all documents share costs one entry a chunk. Messages are byte blobs of sorted numpy arrays. The
documents are shuffled once, by chunk, and Spark reuses that exchange in all three rounds.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

WINDOW, ROUNDS = 20, 7
U64, U32 = np.dtype("<u8"), np.dtype("<u4")
OUT = "doc_id bigint, text string, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>"


def anchors(w: W.Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, names of their anchors, whether the window before has another one)."""
    n = len(w.h)
    at = np.flatnonzero(W.gram_starts(w.ptr, window, n))
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, bool)
    best_lo, best_hi = at.copy(), at + 1  # a word is a symbol that nothing else determines

    def offer(lo: np.ndarray, hi: np.ndarray) -> bool:
        """Take the first symbol whose stretch starts in the window, if it ends there; lo and hi ascend."""
        before = np.cumsum(np.bincount(np.maximum(lo, -1) + 1, minlength=n + 1))
        k = np.minimum(before[at], len(lo) - 1)
        ok = (lo[k] >= at) & (hi[k] <= at + window)
        np.copyto(best_lo, lo[k], where=ok)
        np.copyto(best_hi, hi[k], where=ok)
        return bool(ok.any())

    doc = w.doc
    head = np.ones(n, bool)
    head[1:] = (w.h[1:] != w.h[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(head)
    size = np.diff(np.append(s, n))
    name = np.where(size > 1, W.mix(w.h[s] ^ W.mix(size.astype(np.uint64))), w.h[s])
    lo, hi, own = s - 1, s + size + 1, doc[s]  # a run is known by the words beside it; there is none at a text's ends
    offer(lo, hi)
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        left = (W.mix(name ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (2**64 - 1))) >> np.uint64(63)) == 0
        beside = own[1:] == own[:-1]
        joins = np.zeros(m, bool)  # with the next one
        joins[:-1] = left[:-1] & ~left[1:] & beside
        second = np.zeros(m, bool)
        second[1:] = joins[:-1]
        k = np.flatnonzero(~second)
        pair = joins[k]
        nxt, prv = np.minimum(k + 1, m - 1), np.maximum(k - 1, 0)
        has_next, has_prev = np.append(beside, False)[k], np.concatenate(([False], beside))[k]
        alone_left = ~pair & left[k]
        new_hi = np.where(pair, hi[nxt], np.where(alone_left, np.where(has_next, hi[nxt], np.maximum(hi[k], w.ptr[own[k] + 1] + 1)), hi[k]))
        new_lo = np.where(pair | alone_left, lo[k], np.where(has_prev, lo[prv], np.minimum(lo[k], w.ptr[own[k]] - 1)))
        name = np.where(pair, W.mix(name[k] * np.uint64(0x9E3779B97F4A7C15) + W.mix(name[nxt])), name[k])
        lo, hi, own = new_lo, new_hi, own[k]
        if not offer(lo, hi):
            break
    fresh = np.ones(len(at), bool)
    fresh[1:] = (best_lo[1:] != best_lo[:-1]) | (best_hi[1:] != best_hi[:-1])
    return at, W.Sequences(w.h).of(best_lo, best_hi), fresh


def _sorted(table: pa.Table) -> pa.Table:
    """In the order that decides what is first: doc_id (null last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _split(buckets: int, key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each bucket, in the order of ``key``; ``key`` is sorted."""
    b = (W.mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order])) + 1
    return [(int(b[x[0]]), x) for x in np.split(order, edges)] if len(key) else []


def _blob(x: np.ndarray, kind: np.dtype) -> bytes:
    return x.astype(kind, copy=False).tobytes()


def _send_names(buckets: int, window: int):
    def send(table: pa.Table) -> pa.Table:
        data, off = W.utf8(table["text"])
        c, found, many = table["c"][0].as_py(), [], []
        for i, j in W.runs(off):
            _, name, fresh = anchors(W.words(data[off[i] : off[j]], off[i : j + 1] - off[i]), window)
            one, count = np.unique(name[fresh], return_counts=True)
            found.append(one)
            many.append(count > 1)
        name = np.concatenate(found)
        one, back, count = np.unique(name, return_inverse=True, return_counts=True)
        multi = count > 1
        multi[back[np.concatenate(many)]] = True
        rows = [(b, c, _blob(one[x], U64), np.packbits(multi[x]).tobytes()) for b, x in _split(buckets, one)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["b", "c", "names", "multi"])

    return send


def _answer_names(table: pa.Table) -> pa.Table:
    """To every chunk those of its names that the corpus has at more than one place."""
    parts = [np.frombuffer(x, U64) for x in table["names"].to_pylist()]
    multi = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["multi"].to_pylist(), parts, strict=True)])
    name = np.concatenate(parts)
    _, back, count = np.unique(name, return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, back, multi.astype(bool))
    keep, at, rows = shared[back], 0, []
    for c, p in zip(table["c"].to_pylist(), parts, strict=True):
        mine = p[keep[at : at + len(p)]]
        at += len(p)
        if len(mine):
            rows.append((c, mine.tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["c", "names"])


def _gathered(blobs: pa.ChunkedArray, kind: np.dtype = U64) -> np.ndarray:
    got = [np.frombuffer(x, kind) for x in blobs.to_pylist() if x]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, kind)


def _prints(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return W.Sequences(w.h).grams(window), (W.Sequences(w.h, W.P_TWO).grams(window) >> np.uint64(32)).astype(U32)


def _send_prints(buckets: int, window: int):
    def send(docs: pa.Table, answer: pa.Table) -> pa.Table:
        names, rows = _gathered(answer["names"]), []
        if len(names) and docs.num_rows:
            docs = _sorted(docs)
            data, off = W.utf8(docs["text"])
            ids = docs["doc_id"].combine_chunks()
            c, base, parts = docs["c"][0].as_py(), 0, []
            for i, j in W.runs(off):
                w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at, name, _ = anchors(w, window)
                at = at[W.lookup(names, name) >= 0] if len(at) else at
                if len(at):
                    one, two = _prints(w, window)
                    d = w.doc[at]
                    parts.append((one[at], two[at], d + i, at - w.ptr[d]))
            if parts:
                f, g, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((s, d, g, f))
                f, g, d, s = f[order], g[order], d[order], s[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
                k = np.flatnonzero(new)
                count = np.diff(np.append(k, len(f)))
                f, g, d, s = f[k], g[k], d[k], s[k]
                null = np.iinfo(np.int64).max
                ids = np.asarray(ids.cast(pa.int64()).fill_null(null))
                for b, x in _split(buckets, f):
                    dictionary, place = np.unique(ids[d[x]], return_inverse=True)
                    rows.append((b, c, _blob(f[x], U64), _blob(g[x], U32), dictionary.astype("<i8").tobytes(), _blob(place, U32), _blob(s[x], U32), np.packbits(count[x] > 1).tobytes()))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=["b", "c", "f", "g", "ids", "place", "start", "multi"])

    return send


def _answer_prints(table: pa.Table) -> pa.Table:
    """To every chunk its repeated fingerprints: those to remove wholly, and those it has first."""
    cols = {k: table[k].to_pylist() for k in table.column_names}
    f = [np.frombuffer(x, U64) for x in cols["f"]]
    size = [len(x) for x in f]
    f, g = np.concatenate(f), np.concatenate([np.frombuffer(x, U32) for x in cols["g"]])
    d = np.concatenate([np.frombuffer(x, "<i8")[np.frombuffer(y, U32)] for x, y in zip(cols["ids"], cols["place"], strict=True)])
    s = np.concatenate([np.frombuffer(x, U32) for x in cols["start"]])
    multi = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(cols["multi"], size, strict=True)]).astype(bool)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((np.asarray(cols["c"])[row], s, d, g, f))
    f, g, row, multi = f[order], g[order], row[order], multi[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=multi) > 0)
    keep = repeated[group]
    f, first, row = f[keep], new[keep], row[keep]
    back = np.argsort(row, kind="stable")
    f, first, row = f[back], first[back], row[back]
    edges, out = np.searchsorted(row, np.arange(len(size) + 1)), []
    for r, c in enumerate(cols["c"]):
        a, b = edges[r], edges[r + 1]
        if b > a:
            out.append((c, _blob(f[a:b][~first[a:b]], U64), _blob(f[a:b][first[a:b]], U64)))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["c", "gone", "first"])


def _spans(mask: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Ranges of true places of every document, as an Arrow list."""
    n = len(mask)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[ptr[:-1][ptr[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[ptr[1:][ptr[1:] > 0] - 1] = False
    s, e = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    base = np.repeat(ptr[:-1], np.diff(ptr))[s] if len(s) else s
    values = pa.StructArray.from_arrays([pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(s, ptr).astype(np.int32)), values)


def _write(window: int):
    def write(docs: pa.Table, answer: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})
        docs = _sorted(docs)
        gone, first = _gathered(answer["gone"]), _gathered(answer["first"])
        taken = np.zeros(len(first), bool)
        data, off = W.utf8(docs["text"])
        texts, n_words, n_removed, spans = [], [], [], []
        for i, j in W.runs(off):
            w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = len(w.h)
            mask = np.zeros(n, bool)
            if len(gone) or len(first):
                at = np.flatnonzero(W.gram_starts(w.ptr, window, n))
                f = W.Sequences(w.h).grams(window)[at] if len(at) else np.zeros(0, np.uint64)
                hit = W.lookup(gone, f) >= 0
                place = W.lookup(first, f)
                own = np.flatnonzero(place >= 0)
                if len(own):  # in order: the first of all stays
                    which, lead = np.unique(place[own], return_index=True)
                    stays = np.zeros(len(at), bool)
                    stays[own[lead[~taken[which]]]] = True
                    taken[which] = True
                    hit |= (place >= 0) & ~stays
                mask = W.covered(n, at[hit], at[hit] + window)
            raw = w.data.tobytes()
            removed = np.diff(np.concatenate(([0], np.cumsum(mask)))[w.ptr])
            for d in range(j - i):
                own = raw[w.off[d] : w.off[d + 1]].split()
                if removed[d]:
                    own = compress(own, (~mask[w.ptr[d] : w.ptr[d + 1]]).tolist())
                texts.append(b" ".join(own))
            n_words.append(np.diff(w.ptr))
            n_removed.append(removed)
            spans.append(_spans(mask, w.ptr))
        return pa.table({"doc_id": docs["doc_id"], "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": np.concatenate(n_words).astype(np.int64), "n_removed": np.concatenate(n_removed).astype(np.int64), "spans": pa.chunked_array(spans)})

    return write


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunks: int | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans), one row for each row of ``docs``.

    A word goes if a window of ``window`` consecutive words that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one; windows are judged on the input.
    ``text`` is what is left, joined by single spaces; ``spans`` the word ranges that went.
    Of rows with equal doc_id a fixed, otherwise arbitrary one counts as the earlier; a null doc_id
    comes last; null text has no words. Other columns are ignored; no rows give no rows. ``chunks``
    defaults to twice the partitions of the input.
    """
    chunks = chunks or 2 * max(1, docs.rdd.getNumPartitions())
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("c", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    by_chunk = dealt.groupBy("c")
    names = by_chunk.applyInArrow(_send_names(chunks, window), "b int, c int, names binary, multi binary")
    names = names.groupBy("b").applyInArrow(_answer_names, "c int, names binary")
    prints = by_chunk.cogroup(names.groupBy("c")).applyInArrow(_send_prints(chunks, window), "b int, c int, f binary, g binary, ids binary, place binary, start binary, multi binary")
    prints = prints.groupBy("b").applyInArrow(_answer_prints, "c int, gone binary, first binary")
    return by_chunk.cogroup(prints.groupBy("c")).applyInArrow(_write(window), OUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

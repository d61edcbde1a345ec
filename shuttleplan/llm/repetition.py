"""Quality rules on repetition inside a document, from suffix arrays over words.

The words of a run of whole documents are sorted as suffixes by prefix doubling in numpy (ranks of
1, 2 and 4 words for all places, longer ones only for places that still tie inside their
document). Neighbouring suffixes give longest common prefixes; the intervals where these are at
least ``min_words`` are the repeated substrings, the longest prefix that a place shares with a
neighbour is the maximal repeat that starts there. Spans are united, and two limits hold: the share
of words inside repeats, and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

#: base rules: fixed by the contract
BASE_WINDOW, BASE_MIN_WORDS, BASE_MAX_PERCENT = 8, 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, longest_repeat bigint, covered_words bigint, n_repeats bigint"


def longest_repeats(word: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For every place, the words that its suffix shares with another suffix of its document at most.

    ``word`` holds dense word ids of documents ``ptr[i]:ptr[i + 1]``. Only repeats of four words or
    more are told apart; below that the answer is 0.
    """
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    end = np.repeat(ptr[1:], np.diff(ptr))
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    place = np.arange(n)

    def shifted(rank: np.ndarray, h: int, at: np.ndarray) -> np.ndarray:
        to = at + h
        ok = to < end[at]
        return np.where(ok, rank[np.minimum(to, n - 1)] + 1, 0)

    ranks = {1: word.astype(np.int64)}
    for h in (1, 2):
        key = ranks[h] * (int(ranks[h].max()) + 2) + shifted(ranks[h], h, place)
        ranks[2 * h] = np.unique(key, return_inverse=True)[1]
    order = np.argsort(doc * (int(ranks[4].max()) + 1) + ranks[4], kind="stable")
    same = np.zeros(n, bool)  # with the one before in the order: four words alike, one document
    same[1:] = (ranks[4][order[1:]] == ranks[4][order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    head = np.where(same, 0, place)
    np.maximum.accumulate(head, out=head)
    rank = np.empty(n, np.int64)
    rank[order] = head
    h, levels = 4, [(4, rank.copy())]
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        group, follow = rank[at], shifted(rank, h, at)
        again = np.lexsort((follow, group))
        at, group, follow = at[again], group[again], follow[again]
        order[slots] = at
        equal = np.zeros(len(slots), bool)
        equal[1:] = (group[1:] == group[:-1]) & (follow[1:] == follow[:-1]) & (follow[1:] > 0)
        same[slots] = equal
        head = np.where(equal, 0, slots)
        np.maximum.accumulate(head, out=head)
        rank[at] = head
        h *= 2
        levels.append((h, rank.copy()))
    # longest common prefix of neighbours that share four words, by halving steps
    pair = np.flatnonzero((levels[0][1][order[1:]] == levels[0][1][order[:-1]])) + 1
    a, b = order[pair - 1], order[pair]
    lcp = np.zeros(len(pair), np.int64)
    for size, level in [*reversed(levels), (2, ranks[2]), (1, ranks[1])]:
        x, y = a + lcp, b + lcp
        fits = (x + size <= end[a]) & (y + size <= end[b])
        hit = fits & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        lcp += size * hit
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[off])


def measure(data: np.ndarray, off: np.ndarray, min_words: int) -> list[np.ndarray]:
    """The columns of COLUMNS for a run of documents."""
    w = W.words(data, off)
    n, docs = len(w.h), len(off) - 1
    rep = longest_repeats(np.unique(w.h, return_inverse=True)[1] if n else w.h, w.ptr)
    base = np.flatnonzero(rep >= BASE_WINDOW)
    repeated = W.covered(n, base, base + BASE_WINDOW)
    long = np.flatnonzero(rep >= min_words)
    inside = W.covered(n, long, long + rep[long])
    # a maximal repeat begins where the place before does not carry a repeat that is one word longer
    maximal = (rep >= min_words) & ~np.concatenate(([False], (rep[:-1] == rep[1:] + 1)))[:n] if n else np.zeros(0, bool)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, w.doc[long], rep[long])
    blank = ~W.PLAIN[data]
    dup = np.zeros(docs, np.int64)
    raw = data.tobytes()
    for d in range(docs):
        lines = [x for x in raw[off[d] : off[d + 1]].split(b"\n") if x.strip(b" \t\r\v\f")]
        dup[d] = len(lines) - len(set(lines))
    return [
        np.diff(w.ptr), _per_doc(~blank & ((data & 0xC0) != 0x80), off), _per_doc(SYMBOLS[data], off), dup,
        _per_doc(repeated, w.ptr), longest, _per_doc(inside, w.ptr), _per_doc(maximal, w.ptr),
    ]


def repetition(docs: DataFrame, min_words: int = 5, max_percent: int = 40, max_longest: int = 60, max_longest_percent: int = 15) -> DataFrame:
    """(doc_id, the measures of COLUMNS, base_failed, kept), one row for each row of ``docs``.

    ``kept`` is false if the base rules fail, if more than ``max_percent`` of the words lie in
    repeats of ``min_words`` words or more, or if the longest repeat has over ``max_longest`` words
    and over ``max_longest_percent`` of the text. Null or blank text has no words, so it fails the
    base. Repeated rows are judged alike; other columns are ignored; no rows give no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column(1))
            parts = [measure(data[off[i] : off[j]], off[i : j + 1] - off[i], min_words) for i, j in W.runs(off)]
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(W.tidied(judge), f"doc_id {kind}, {COLUMNS}")
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_PERCENT * F.col("n_words"))
    many = 100 * F.col("covered_words") > max_percent * F.col("n_words")
    long = (F.col("longest_repeat") > max_longest) & (100 * F.col("longest_repeat") > max_longest_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~many & ~long)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))

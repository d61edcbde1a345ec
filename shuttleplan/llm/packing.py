"""Packing of tokenised documents into sequences by bin completion.

Pieces are dealt by a hash over packing groups, so every group has the corpus's mixture of lengths
and packs on its own; a group is filled bin by bin around the largest piece left. For it the
undominated fillings are enumerated: one in which a piece left outside could replace some of the
pieces inside without a loss is not tried. Branch and bound runs over these choices: the waste so far
must stay under what the incumbent (best fit decreasing, first) wastes, and a packing that meets the
bound ceil(tokens / capacity) ends the search. It is complete for groups of up to ``EXACT`` pieces; in
larger ones the parameters of ``complete`` bound what is tried. Lengths are integers, so a group is
searched on its counts by length, and pieces of equal length are told apart when the bins are written.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.llm import wordhash as W

CAPACITY, END_ID = 4096, 1
#: pieces up to which the search is complete; beyond: lengths tried at a place, maximal fillings looked at for a bin, bins tried a piece
EXACT, WIDTH, MOST, NODES = 20, 4, 64, 1
#: bytes of text whose words are looked up at once; two workers of an executor hold several numbers a word
RUN = 1 << 18
#: words that a worker keeps between tasks; more would add to the memory of idle workers
KEPT = 200_000
SYMBOL, PLAIN_CHAR = (np.isin(np.arange(256), list(x)) for x in (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: words of which the tokenizer makes one piece each; the lower case of \u0130 is a letter and a mark
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but before what may be a combining mark: some marks join small letters alone, and the tokenizer joins them first."""
    out = W.LOWER[data]
    before = np.flatnonzero(data[1:] >= 0xCC)
    out[before] = data[before]
    return out


def _letter(lead: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter of ``LETTERS``."""
    return (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((low == 0x97) | (low == 0xB7))) & ~((lead == 0xC4) & (low == 0xB0))


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places in words where one token ends and another begins: between letter or digit and ASCII symbol, but after an apostrophe, for ``'s`` is a token."""
    at = np.flatnonzero(SYMBOL[data])
    a, b = at[at > 0], at[(at < len(data) - 1) & (data[at] != ord("'"))]
    left, right = data[a - 1], data[b + 1]
    ends = PLAIN_CHAR[left] | _letter(data[np.maximum(a - 2, 0)], left)
    begins = PLAIN_CHAR[right] | _letter(right, data[np.minimum(b + 2, len(data) - 1)])
    cuts = np.sort(np.concatenate((a[ends], b[begins] + 1)))
    return cuts[off[np.searchsorted(off, cuts)] != cuts]  # where texts meet, words end already


class Encoder:
    """Token ids of whole texts from ids of their words, which are encoded once each.

    The tokenizer drops white space and never joins across it, nor letters or digits with symbols, so
    a text's ids are those of its words in order. Words are found and hashed as bytes; the library
    encodes words not seen yet, those of letters alone many in one text.
    """

    def __init__(self, path: str, max_words: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok, self.max_words = Tokenizer.from_file(path), max_words
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        #: by id, whether a token ends a word
        self.last = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix) for i in range(self.tok.get_vocab_size())])
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def forget(self, most: int) -> None:
        """Keep the ``most`` words met first."""
        if len(self.known) > most:
            end = int(np.partition(self.at, most)[most])
            own = self.at < end
            self.known, self.at, self.size, self.flat = self.known[own], self.at[own], self.size[own], self.flat[:end].copy()

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after the other, how many each has)."""
        pure = np.array([LETTERS.fullmatch(w) is not None for w in words])
        rest = [w for w, p in zip(words, pure, strict=True) if not p]
        text = " ".join(w for w, p in zip(words, pure, strict=True) if p)
        joined = self._ids([text])[0]
        joined = np.fromiter(joined, np.int64, len(joined))
        ends = np.flatnonzero(self.last[joined]) + 1
        if len(ends) != len(words) - len(rest):  # a tokenizer that marks no ends, or not one a word
            pure[:], rest, joined, ends = False, words, joined[:0], ends[:0]
        apart = self._ids(rest)
        size = np.empty(len(words), np.int64)
        size[pure], size[~pure] = np.diff(ends, prepend=0), [len(x) for x in apart]
        out, own = np.empty(int(size.sum()), np.uint32), np.repeat(pure, size)
        out[own], out[~own] = joined, list(chain.from_iterable(apart))
        return out, size

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets)."""
        named = b"<|" in data.tobytes()  # the names of special tokens are told by case
        w = W.words(data if named else _lower(data), off, hashes=False)
        start, end, ptr = w.start, w.end, w.ptr
        if not named:
            cuts = _cuts(w.data, off)
            start, end = (np.sort(np.concatenate((x, cuts)), kind="stable") for x in (start, end))
            ptr = np.searchsorted(start, off)
        h = W.word_hashes(w.data, start, end)
        seen, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = W.lookup(self.known, seen)
        if (place < 0).any():
            if len(self.known) > self.max_words:
                self.reset()
                place = np.full(len(seen), -1)
            new = np.flatnonzero(place < 0)
            raw = w.data.tobytes()
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            size, flat = [], [self.flat]
            for k in range(0, len(a), 2000):  # the library's answers are large
                got, own = self.encode([raw[x:y].decode() for x, y in zip(a[k : k + 2000], b[k : k + 2000], strict=True)])
                flat.append(got)
                size.append(own)
            size = np.concatenate(size)
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate(flat)
            into = np.searchsorted(self.known, seen[new])  # both are sorted
            self.known = np.insert(self.known, into, seen[new])
            self.at, self.size = np.insert(self.at, into, at), np.insert(self.size, into, size)
            place = W.lookup(self.known, seen)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        at, size = self.at[place][back], self.size[place][back]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        return out, np.concatenate(([0], ends))[ptr]


#: kept for the next task of the same Python worker, with the words met first
_encoders: dict[str, Encoder] = W.cache("encoders")


def _encoder(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def _tokenise(path: str, capacity: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            data, off = W.utf8(batch.column(1))
            doc, piece, start, length, crc = [], [], [], [], []
            for i, j in W.runs(off, RUN):
                ids, ptr = encoder.ids(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for d in range(j - i):
                    own = np.append(ids[ptr[d] : ptr[d + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        doc.append(i + d)
                        piece.append(p)
                        start.append(s)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        encoder.forget(KEPT)

    return tokenise


class Lengths:
    """Counts by length, with the largest length present up to a limit."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.mask = 0
        for x in np.flatnonzero(counts).tolist():
            self.mask |= 1 << x

    def below(self, limit: int) -> int:
        """Largest length present that is at most ``limit``; 0 if none."""
        return max(0, (self.mask & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    def take(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            self.mask ^= 1 << x

    def put(self, x: int) -> None:
        if not self.n[x]:
            self.mask |= 1 << x
        self.n[x] += 1


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: the incumbent."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for x in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[x])):
            fit = rooms >> x
            if fit:
                room = x + (fit & -fit).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                b, room = len(bins), capacity
                bins.append([])
            bins[b].append(x)
            left = room - x
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _spread(mask: int, by: int) -> int:
    """Bits of ``mask`` moved up by 1 to ``by`` places."""
    out, done = mask << 1, 1
    while done < by:
        step = min(done, by - done)
        out |= out << step
        done += step
    return out


def dominated(have: Lengths, own: list[int], left: int) -> bool:
    """Whether a length that is not in the filling could replace some of its pieces without a loss.

    It fits into the room left, or in place of pieces that sum to no more than it and to no less than
    it minus the room left. Whatever packs the rest around the filling then packs it around the
    better one: the replaced pieces go where the longer one was.
    """
    if have.below(left):
        return True
    single = several = 0
    for x in own:
        several |= (single | several) << x
        single |= 1 << x
    return bool(several & have.mask or (left and _spread(single | several, left) & have.mask))


def fillings(have: Lengths, room: int, width: int | None = None, most: int | None = None) -> list[list[int]]:
    """Undominated fillings of ``room``, least waste first; a single piece that fills it dominates all others.

    Without ``width`` and ``most`` these are all of them. With them at most ``width`` lengths are
    tried at a place and at most ``most`` maximal fillings are looked at.
    """
    one = have.below(room)
    if one == room or not one:
        return [[one] if one else []]
    out: list[tuple[int, list[int]]] = []
    own: list[int] = []
    seen = 0

    def grow(left: int, cap: int) -> None:
        nonlocal seen
        x, tried = have.below(min(left, cap)), 0
        if not x:
            seen += 1
            if not dominated(have, own, left):
                out.append((left, list(own)))
        while x and (width is None or tried < width) and (most is None or seen < most):
            have.take(x)
            own.append(x)
            grow(left - x, x)
            own.pop()
            have.put(x)
            tried += 1
            x = have.below(x - 1)

    grow(room, room)
    if not out:  # all looked at are dominated: the bounds cut off those that dominate them
        while one:
            have.take(one)
            own.append(one)
            one = have.below(room - sum(own))
        for x in own:
            have.put(x)
        return [own]
    out.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in out]


def complete(counts: np.ndarray, capacity: int, exact: int = EXACT, width: int = WIDTH, most: int = MOST, nodes: int = NODES) -> list[list[int]]:
    """Bins of lengths for counts by length, as few as possible for up to ``exact`` pieces.

    For more pieces the search is bounded: ``width`` and ``most`` by bin, ``nodes`` bins tried a
    piece in all; best fit decreasing stays the answer if that finds nothing better.
    """
    pieces, total = int(counts.sum()), int((counts * np.arange(len(counts))).sum())
    least = -(-total // capacity)
    incumbent = best_fit(counts, capacity)
    if len(incumbent) <= least:
        return incumbent
    small = pieces <= exact
    have, bins, waste = Lengths(counts), [], 0
    stack: list[list[list[int]]] = []  # options left at each depth; bins holds those chosen
    step = 0
    while small or step < nodes * pieces:
        step += 1
        big = have.below(capacity)
        options: list[list[int]] = []
        if waste <= (len(incumbent) - 1) * capacity - total:  # else no better packing is below
            if not big:
                incumbent = [list(b) for b in bins]
                if len(incumbent) <= least:
                    break
            else:
                have.take(big)
                options = [[big, *f] for f in reversed(fillings(have, capacity - big) if small else fillings(have, capacity - big, width, most))]
                have.put(big)
        stack.append(options)
        while stack and not stack[-1]:
            stack.pop()
            if bins:
                old = bins.pop()
                waste -= capacity - sum(old)
                for x in old:
                    have.put(x)
        if not stack:
            break
        chosen = stack[-1].pop()
        for x in chosen:
            have.take(x)
        bins.append(chosen)
        waste += capacity - sum(chosen)
    return incumbent


def _pack_group(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        order = np.argsort(length, kind="stable")
        counts = np.bincount(length, minlength=capacity + 1)
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        used = np.zeros(capacity + 1, np.int64)
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        base = int(table["g"][0].as_py()) << 32
        full = order[first[capacity] : first[capacity] + counts[capacity]]
        seq[full] = base + np.arange(len(full))
        rest = counts.copy()
        rest[capacity] = 0
        for b, own in enumerate(complete(rest, capacity)):
            at = 0
            for x in own:
                row = order[first[x] + used[x]]
                used[x] += 1
                seq[row], offset[row] = base + len(full) + b, at
                at += x
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return pack


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    ``docs`` has doc_id and text; null text is empty and gives the end id alone. ``path`` is the
    tokenizer's file. ``groups`` defaults to the partitions of the input. Repeated rows and ids are
    packed as often as they occur; no rows give no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = groups or max(1, docs.rdd.getNumPartitions())
    fields = PIECES.format(kind=kind)
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(W.tidied(_tokenise(path, capacity), keeps="encoders"), fields))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_pack_group(capacity), f"{fields}, sequence_id bigint, offset bigint")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())

"""Byte-level BPE as a finite-state transducer, and its decoder as a UTF-8 state machine.

The merges are compiled once. A token may follow another if merging the two together gives just these two;
a row of tokens is the merged form of its text exactly if each may follow the one before. So a reader of bytes
needs to know only: which tokens may still be open (a place in the trie of tokens), which token stood before each, and
what each reading has to write. That set is the state; it is formed when it is first met and kept
with its arcs (the subset construction, done lazily). What all readings of a state write alike is emitted
at once, the rest waits for at most as many bytes as the longest token has.

Arcs are formed where a place is met often; a rare piece is read with suffix links instead, by the same rule of which
token may follow which. Texts are split by the vocabulary's pattern, and each piece runs by itself; the ids of pieces
seen before are kept in a bounded table. Where bytes alone show that no match of the pattern goes on (``cuts``), texts
are cut first, and the pattern splits only chunks that are not in the table yet. Decoding gathers the bytes of ids and tracks, id by id, whether a character
is still open: text is given out as soon as its characters are whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

RANKS = "byte_bpe_multi_50k.tiktoken"
#: states, pairs of tokens and pieces kept a process; beyond, the tables start anew
STATES, PAIRS, PIECES = 50_000, 250_000, 350_000
#: slots of the table of verdicts on pairs
SLOTS = 1 << 20
#: meetings of a place before its arc is formed
OFTEN = 128
#: characters up to which a piece's ids are kept; ids decoded at once
SHORT, RUN = 64, 200_000
#: bytes of texts that are split at once
BYTES = 4 << 20
#: patterns by which texts may be cut at ``cuts``: a match is a contraction, letters, digits or other marks, with one space before at most, or white space
CUT = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])
#: kinds of bytes: control, letter, digit, mark, white space, apostrophe, part of a longer character
KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((3, range(0x21, 0x7F)), (1, chain(range(65, 91), range(97, 123))), (2, range(48, 58)), (4, (0x20, *range(9, 14))), (5, b"'"), (6, range(0x80, 0x100))):
    KIND[list(_bytes)] = _kind
#: whether a match ends between two kinds, at 8 * first + second
BETWEEN = np.zeros(64, bool)
for _first, _second in ((1, (2, 3, 4, 5)), (2, (1, 3, 4, 5)), (3, (1, 2, 4)), (5, (2, 4)), (6, (4,))):
    BETWEEN[[8 * _first + k for k in _second]] = True


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """(parts, steps): merges the pair of least rank, the leftmost first, until no pair is a token.

    A step has the rank, and the first and last part after it.
    """
    parts, none = [data[i : i + 1] for i in range(len(data))], len(ranks) << 32
    pairs, steps = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])], []
    while pairs and (rank := min(pairs)) < none:
        at = pairs.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
        steps.append((rank, parts[0], parts[-1]))
    return parts, steps


class Transducer:
    """Bytes of a piece to its token ids. States are rows of (trie node, token before, ids not emitted yet)."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        #: tokens that merging never reaches; they stand for a whole piece only
        self.whole: dict[bytes, int] = {}
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for token, i in ranks.items():
            if len(token) > 1 and len(merge(ranks, token)[0]) > 1:
                self.whole[token] = i
                continue
            node = 0
            for b in token:
                self.inner[node] = True
                node = self.child.setdefault(node << 8 | b, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = i
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, list] = {}
        self._link()
        self.reset()

    def _link(self) -> None:
        """For every node the one of its longest suffix, and where every byte leads (rows of nodes with edges only)."""
        n = len(self.ends)
        edges, to = np.fromiter(self.child.keys(), np.int64, len(self.child)), np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(edges)
        edges, to = edges[order], to[order]
        self.end, self.back = np.array(self.ends, np.int64), np.zeros(n, np.int64)
        self.width = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.width[i] = len(t)
        inner = np.array(self.inner)
        self.row, self.table = np.where(inner, np.cumsum(inner) - 1, -1), np.zeros((inner.sum(), 256), np.int32)
        level = np.zeros(1, np.int64)
        while len(level):
            own = level[inner[level]]
            if own[:1].any():  # below node 0, what is no edge goes on from the longest suffix
                self.table[self.row[own]] = self.table[self.row[self.back[own]]]
            lo, hi = np.searchsorted(edges, own << 8), np.searchsorted(edges, (own + 1) << 8)
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
            node, byte, level = edges[at] >> 8, edges[at] & 255, to[at]
            self.back[level] = np.where(node == 0, 0, self.table[self.row[node], byte])
            self.table[self.row[node], byte] = level
            # a node without edges goes on from its longest suffix that has some, which lies higher up
            rest = level[~inner[level]]
            self.row[rest] = self.row[self.back[rest]]
        self.judged, self.verdict = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def reset(self) -> None:
        self.states = [((0, -1, ()),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: dict[int, int] = {}

    def _steps(self, token: int) -> list:
        if (out := self.steps.get(token)) is None:
            out = self.steps[token] = [*merge(self.ranks, self.tokens[token])[1], (len(self.ranks) << 32, b"", b"")]
        return out

    def follows(self, a: int, b: int) -> bool:
        """May token ``b`` stand right after ``a``: nothing merges across while both form, each at its own pace."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
            self.steps.clear()
        one, two, none = self._steps(a), self._steps(b), len(self.ranks) << 32
        last, first = self.tokens[a][-1:], self.tokens[b][:1]
        i = j = 0
        while True:
            across, next_a, next_b = self.ranks.get(last + first, none), one[i][0], two[j][0]
            if across < next_a and across <= next_b:
                out = False
                break
            if next_a == next_b == none:
                out = True
                break
            if next_a <= next_b:
                last, i = one[i][2], i + 1
            else:
                first, j = two[j][1], j + 1
        self.pairs[a << 32 | b] = out
        return out

    def _may(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        known = self.pairs.get(a << 32 | b)
        return self.follows(a, b) if known is None else known

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """(next state, ids emitted), formed on first use."""
        readings = []
        for node, before, waiting in self.states[state]:
            if (to := self.child.get(node << 8 | byte)) is None:
                continue
            if (t := self.ends[to]) >= 0 and self._may(before, t):
                readings.append((0, t, (*waiting, t)))
            if self.inner[to]:
                readings.append((to, before, waiting))
        least, most = min(r[2] for r in readings), max(r[2] for r in readings)
        n = next((k for k, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
        new = tuple(sorted((node, before, waiting[n:]) for node, before, waiting in readings))
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.arcs[state << 8 | byte] = out = (to, least[:n])
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece, each as soon as no later byte can change it."""
        state = 0
        for byte in chain.from_iterable(chunks):
            state, out = self.arcs.get(state << 8 | byte) or self.arc(state, byte)
            yield from out
        yield from self._closed(self.states[state])

    @staticmethod
    def _closed(readings: tuple) -> tuple[int, ...]:
        """What waits in the one reading whose bytes all stand in closed tokens."""
        return next(waiting for node, _, waiting in readings if node == 0)

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs; a table with one pair a slot keeps the last verdicts."""
        key = a << 32 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (SLOTS - 1)
        out = self.verdict[slot]
        new = np.flatnonzero(self.judged[slot] != key)
        if len(new):
            keys, inverse = np.unique(key[new], return_inverse=True)
            verdicts = np.array([self._may(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], bool)
            out[new] = verdicts[inverse]
            self.judged[slot[new]], self.verdict[slot[new]] = key[new], out[new]
            # of pairs that share a slot the last one stays, with its own verdict
            self.verdict[slot[new]] = verdicts[np.searchsorted(keys, self.judged[slot[new]])]
        return out

    def plain(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of pieces without states: at each place the one token that may follow the one where it starts."""
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        size = np.array([len(pieces[k]) for k in order], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        data = np.frombuffer(b"\0".join([*(pieces[k] for k in order), b""]), np.uint8)
        last, node = np.full(len(data), -1, np.int64), np.zeros(len(pieces), np.int64)
        for i in range(1, int(size.max(initial=0)) + 1):
            n = np.searchsorted(-size, -i, "right")  # pieces that have an i-th byte
            node = self.table[self.row[node[:n]], data[first[:n] + i - 1]]
            left, at = np.arange(n), node
            while len(left):
                t = self.end[at]
                fits = t >= 0
                before = last[first[left] + i - np.where(fits, self.width[t], 0)]
                asked = np.flatnonzero(fits & (before >= 0))
                fits[asked] = self._judge(before[asked], t[asked])
                last[first[left[fits]] + i] = t[fits]
                left, at = left[~fits], self.back[at[~fits]]
        place, owner, found = size.copy(), np.arange(len(pieces)), []
        while (on := place > 0).any():
            place, owner = place[on], owner[on]
            t = last[first[owner] + place]
            place = place - self.width[t]
            found.append((owner, place, t))
        own, at, ids = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        by = np.lexsort((at, own))
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(pieces)))]) * 4
        flat, out = ids[by].astype(np.int32).tobytes(), [b""] * len(pieces)
        for k, a, b in zip(order, ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = flat[a:b]
        return out

    def _known(self, piece: bytes) -> bytes | None:
        """32-bit ids if all arcs on the way are formed. An arc is formed when its place has been met ``OFTEN`` times, so rare pieces leave no states."""
        if piece in self.whole:
            return array("i", [self.whole[piece]]).tobytes()
        state, ids = 0, []
        for byte in piece:
            if (arc := self.arcs.get(key := state << 8 | byte)) is None:
                self.met[key] = n = self.met.get(key, 0) + 1
                if n < OFTEN:
                    return None
                arc = self.arc(state, byte)
            state, out = arc
            if out:
                ids += out
        return array("i", [*ids, *self._closed(self.states[state])]).tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of pieces, as bytes."""
        if len(self.states) > STATES or len(self.met) > 20 * STATES:
            self.reset()
        out = [self._known(p) if len(p) <= SHORT else array("i", self.stream((p,))).tobytes() for p in pieces]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.plain([pieces[k] for k in rest])):
            out[k] = x
        return out


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes before which a match of a pattern in ``CUT`` ends and no look-ahead reaches over.

    No match goes on from a character that is not white space to white space, nor between letters, digits and marks, but
    for an apostrophe and the letters after it. Only ASCII characters are told apart; white space after a longer
    character is a place only if that one cannot be white space itself.
    """
    kind = KIND[data]
    at = np.flatnonzero(BETWEEN[kind[:-1] * 8 + kind[1:]]) + 1
    far = np.flatnonzero(kind[at - 1] == 6)
    one, two = data[at[far] - 2], data[np.maximum(at[far] - 3, 0)]
    # U+0085 and U+00A0; U+1680; U+2000 to U+205F; U+3000
    blank = (one == 0xC2) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE3) & (one == 0x80))
    return np.delete(at, far[blank])


class Encoder:
    """Ids of whole texts; of chunks and of the pattern's matches only those not seen before are encoded."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.machine, self.pattern, self.cut = Transducer(read_ranks(path)), regex.compile(pattern), pattern in CUT
        self.pieces: dict[str, bytes] = {}

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts one after another, number of chunks of each): ranges between cuts, else the matches."""
        if self.cut:
            data, off = W.utf8(texts)
            first = np.zeros(len(data), bool)
            first[cuts(data)] = True
            first[off[:-1][np.diff(off) > 0]] = True
            start = np.flatnonzero(first)
            ends = np.append(start, len(data))
            return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data)), np.diff(np.searchsorted(start, off))
        matches = [self.pattern.findall(t or "") for t in texts.to_pylist()]
        return pa.array([*chain.from_iterable(matches)], pa.large_string()), np.fromiter(map(len, matches), np.int64, len(matches))

    def _learn(self, new: list[str]) -> list[str]:
        """Keep the ids of chunks; gives what is new. Those of a chunk that is one match are kept once; a match taken alone is a match again."""
        split = [*map(self.pattern.findall, new)] if self.cut else [[p] for p in new]
        todo = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.pieces]
        self.pieces.update(zip(todo, self.machine.encode([p.encode() for p in todo])))
        self.pieces.update((p, b"".join(map(self.pieces.__getitem__, own))) for p, own in zip(new, split) if len(own) != 1)
        return new + todo

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit ids of all texts one after another, number of ids of each); null is empty."""
        chunks, count = self._chunks(texts)
        coded = chunks.dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = self._learn([p for p in pieces if p not in self.pieces])
        forms = [*map(self.pieces.__getitem__, pieces)]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        for p in new:
            if len(p) > SHORT:
                self.pieces.pop(p, None)
        size = np.fromiter(map(len, forms), np.int64, len(forms)) // 4
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(forms), np.int32)
        width = size[code]
        done = np.concatenate([[0], np.cumsum(width)])
        out = flat[np.repeat(first[code] - done[:-1], width) + np.arange(done[-1])]
        return out, np.diff(done[np.concatenate([[0], np.cumsum(count)])])


def _utf8_states() -> tuple[np.ndarray, int]:
    """(next state by state and byte, the state of broken text); state 0 stands between characters."""
    start, broken = (0, 0, 0), (-1, 0, 0)
    # bytes to come and the range of the next one, by the first byte of a character
    lead = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)}, **{b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}}
    lead |= {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
    states = [start, *sorted({*lead.values(), (1, 0x80, 0xBF), (2, 0x80, 0xBF)}), broken]
    table = np.full((len(states), 256), len(states) - 1, np.int8)
    for s, (left, low, high) in enumerate(states[:-1]):
        for b in range(256):
            if left == 0:
                to = start if b < 0x80 else lead.get(b, broken)
            else:
                to = broken if not low <= b <= high else start if left == 1 else (left - 1, 0x80, 0xBF)
            table[s, b] = states.index(to)
    return table, len(states) - 1


class Decoder:
    """Text of ids, given out as its characters become whole; broken bytes become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        table, self.broken = _utf8_states()
        #: state after an id, by the state before it
        self.after = np.full((len(table), len(self.token)), self.broken, np.int8)
        for t, i in ranks.items():
            state = np.arange(len(table))
            for b in t:
                state = table[state, b]
            self.after[:, i] = state
        self.open = self.after[0] != 0
        self.reset()

    def reset(self) -> None:
        self.state, self.held, self.bad = 0, b"", False

    def feed(self, ids: np.ndarray) -> str:
        raw = self.held + b"".join(map(self.token.__getitem__, ids.tolist()))
        state, at, odd = self.state, 0, np.flatnonzero(self.open[ids])
        while at < len(ids):
            if state == 0:  # on to the next id that leaves a character open
                k = np.searchsorted(odd, at)
                if k == len(odd):
                    break
                at = odd[k]
            state = self.after[state, ids[at]]
            at += 1
            if state == self.broken:
                self.bad = True
                break
        self.state = 0 if self.bad else int(state)
        hold = 0
        if self.state or self.bad:  # back to the first byte of the last character
            hold = next((k for k in range(1, min(4, len(raw)) + 1) if raw[-k] & 0xC0 != 0x80), 0)
        self.held = raw[len(raw) - hold :]
        return raw[: len(raw) - hold].decode("utf-8", "replace" if self.bad else "strict")

    def finish(self) -> str:
        rest = self.held.decode("utf-8", "replace")
        self.reset()
        return rest


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encoder(path: str, pattern: str) -> Callable[[str | Column], Column]:
    """Column function: text to array<int>; null gives an empty array. ``path`` names the rank file on every executor."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = _encoder(path, pattern)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // BYTES
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            if len(run):
                flat, n = own.ids(texts.slice(run[0], len(run)))
                ids.append(flat)
                counts.append(n)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    return encode


def decoder(path: str) -> Callable[[str | Column], Column]:
    """Column function: array<int> to text; null gives null, an unknown id fails."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own, out = _decoder(path), []
        values, offsets, null = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
        for k, gone in enumerate(null):
            ids = values[offsets[k] : offsets[k + 1]]
            out.append(None if gone else "".join([*(own.feed(ids[i : i + RUN]) for i in range(0, len(ids), RUN)), own.finish()]))
        return pa.array(out, pa.string())

    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): one row a row of ``docs``, in which doc_id and text are read and other columns ignored.

    Null and empty texts have no ids; repeated rows and null ids are encoded as often as they occur.
    """
    return docs.select("doc_id", encoder(path, pattern)("text").alias("ids"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) plus ``decoded``, the text."""
    return encoded.select("doc_id", "ids", decoder(path)("ids").alias("decoded"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to; null text is empty."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
    found = decode_documents(encoded, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

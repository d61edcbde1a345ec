"""The BPE transducer and its decoder against tiktoken and Python's codecs."""

import random
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from shuttleplan.llm import bytebpe as B

PATH = P.path(B.RANKS)


@lru_cache(1)
def other():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@lru_cache(1)
def own():
    return B.Encoder(PATH, P.PATTERN)


def texts(n=1500):
    rng = random.Random(3)
    kinds = ["ab", "aeiou ", "thein '", "01 ", "éßü ", "\n \t x", "日本語のab ", "a", "=-_*# ", "\x1c   b"]
    return ["".join(rng.choice(k) for _ in range(rng.randint(0, 80))) for k in (rng.choice(kinds) for _ in range(n))]


@pytest.mark.parametrize("zero", [False, True])
def test_encoding(zero):
    some = [*texts(), None, "", " ", "a  b", "a   b\n\n c ", "<|endoftext|>", "don't we'll", "x" * 5000, "ab " * 4000]
    some += ["a\0b"] if zero else []
    for _ in range(2):  # the second time from the tables
        flat, counts = own().ids(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [other().encode_ordinary(t or "") for t in some]


def test_transducer_emits_early():
    machine, longest = own().machine, max(map(len, own().machine.tokens.values()))
    for piece in (b" international", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語".encode() * 20, random.Random(1).randbytes(60)):
        read = [0]

        def byte_by_byte():
            for k in range(len(piece)):
                read[0] = k + 1
                yield piece[k : k + 1]

        ids, done = [], 0
        for i in machine.stream(byte_by_byte()):
            ids.append(i)
            done += len(machine.tokens[i])
            assert read[0] - done <= 2 * longest
        assert [machine.tokens[i] for i in ids] == B.merge(machine.ranks, piece)[0]
        assert np.frombuffer(machine.plain([piece])[0], np.int32).tolist() == ids


def test_tokens_that_merging_never_reaches():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cd": 258}
    enc, same = B.Transducer(ranks), tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for t in ("abc", "abcd", "xabc", "bcd", "abcabc"):
        assert np.frombuffer(enc.encode([t.encode()])[0], np.int32).tolist() == same.encode_ordinary(t)
    with pytest.raises(ValueError):
        B.Transducer({b"a": 0})


def test_decoder_in_small_steps():
    rng, d = random.Random(5), B.Decoder(B.read_ranks(PATH))
    for t in texts(200):
        ids, got = np.array(other().encode_ordinary(t), np.int32), ""
        for k in range(len(ids)):
            got += d.feed(ids[k : k + 1])
            assert t.startswith(got)
        assert got + d.finish() == t
    for _ in range(300):  # ids whose bytes are no text
        ids = np.array([rng.randrange(50_000) for _ in range(6)], np.int32)
        raw = b"".join(other().decode_single_token_bytes(int(i)) for i in ids)
        assert "".join([d.feed(ids[:3]), d.feed(ids[3:]), d.finish()]) == raw.decode("utf-8", "replace")


def test_frames(spark):
    rows = [(i, t, 1, "d") for i, t in enumerate(texts(60))] + [(None, "null id", 1, "d"), (7, None, 1, "d"), (7, None, 1, "d"), (8, "long words and more " * 60_000, 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, decoded string").repartition(3)
    got = B.decode_documents(B.encode_documents(docs, PATH, P.PATTERN), PATH).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, len(r[1]))
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(((i, other().encode_ordinary(t or ""), t or "") for i, t, *_ in rows), key=key)
    assert B.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_cutting_keeps_matches():
    """Texts are cut only where matches end, whatever stands around, and the pattern reads a chunk that repeats once."""
    rng = random.Random(9)
    parts = [*"aZ7!' \n\t", "'s", "'re", "  ", "\r\n", *"\x00\x1c\x7f\x85\xa0        　​—。́۳éж語"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    encoder = B.Encoder(PATH, P.PATTERN)
    flat, counts = encoder.ids(pa.array(some))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [other().encode_ordinary(t) for t in some]
    read = []

    class Pattern:
        def findall(self, text, real=encoder.pattern):
            read.append(len(text))
            return real.findall(text)

    encoder.pattern, text = Pattern(), " ".join(f"w{k % 100}, it's" for k in range(5000))
    flat, _ = encoder.ids(pa.array([text]))
    assert flat.tolist() == other().encode_ordinary(text)
    assert sum(read) < len(text) / 10

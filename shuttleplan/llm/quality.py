"""Quality classifier from weak labels, with a scorer for toxic documents beside it.

Overlapping heuristic labellers vote good, bad or nothing on every document. Spark counts the vote
patterns (3 to the number of labellers at most), and expectation-maximisation over the counts
estimates the classes (good, and several ways to be bad), each labeller's rates in them and the
posterior of every pattern. The posteriors of a bounded
hash sample train a hashed linear scorer by stochastic gradient descent; it scores every document.

Toxic documents are written as fluently as others, so no form heuristic sees them. Their scorer stands
apart from the classifier and gives columns of its own; it is trained on a bounded sample of the labelled rows: log-odds of hashed words and word beginnings, of
which those that a sample backs by enough toxic and hardly any clean texts count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

BITS = 16
#: rows that train the scorers at most, in expectation
SAMPLE_ROWS, TOXIC_ROWS = 5000, 20_000
GOOD, BAD, NONE = 1, 0, 2
#: per labeller: statistic, votes bad beyond the first value, good up to the second
LABELLERS = (
    ("symbols", 0.3, 0.05), ("marked_words", 0.3, 0.05), ("marks", 0.12, 0.08), ("upper", 0.5, 0.25), ("upper_words", 0.5, 0.2),
    ("same_word", 0.5, 0.45), ("same_pair", 0.3, 0.2), ("same_line", 0.5, 0.1), ("no_stop", 0.7, 0.6), ("short", 0.15, 0.03),
)
#: words and characters of an ordinary text that every share is weighed against, so that a few words prove little
PRIOR_WORDS, PRIOR_CHARS = 20, 80
#: a word or pair of words counts as repeated within so many words before it
WORD_WINDOW, PAIR_WINDOW = 50, 100
MIN_TOXIC_TEXTS, MIN_ODDS = 4, 3.5


def repeats(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Whether the same hash stands within ``window`` places before, in the same document."""
    out = np.zeros(len(h), bool)
    order = np.lexsort((np.arange(len(h)), h, doc))
    a, b = order[:-1], order[1:]
    out[b] = (h[a] == h[b]) & (doc[a] == doc[b]) & (b - a <= window)
    return out


def statistics(w: W.Words) -> np.ndarray:
    """Documents x labellers: shares that the labellers judge, 0 where there is nothing to judge.

    All of them are rates over a text of any length; those that a few words move much are weighed
    against PRIOR_WORDS words or PRIOR_CHARS characters of an ordinary text.
    """
    docs, n, data = len(w.ptr) - 1, np.maximum(np.diff(w.ptr), 1), w.data
    words = np.diff(w.ptr)

    def count(flag: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=c[1:])
        return np.diff(c[w.off])

    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    doc = w.doc
    at = np.flatnonzero(W.gram_starts(w.ptr, 2, len(w.h)))
    pairs = W.Sequences(w.h).of(at, at + 2) if len(at) else np.zeros(0, np.uint64)
    raw = data.tobytes()
    same_line = np.zeros(docs)
    for d in range(docs):
        lines = [x for x in raw[w.off[d] : w.off[d + 1]].split(b"\n") if len(x) > 20]
        same_line[d] = 1 - len(set(lines)) / len(lines) if lines else 0
    noise = np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    ends = w.data[w.end - 1] if len(w.h) else np.zeros(0, np.uint8)
    alnum = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    solid = count(W.PLAIN[data])
    capital = (ends >= 65) & (ends <= 90) | (ends == 33)
    stops = count(np.isin(data, np.frombuffer(b".?", np.uint8)))
    some = words > 0
    return np.stack([
        count(noise) / n,
        np.bincount(doc, weights=np.isin(ends, np.frombuffer(b"#*$%&|<>!", np.uint8)), minlength=docs) / n,
        (count(~alnum & W.PLAIN[data]) + 0.03 * PRIOR_CHARS) / (solid + PRIOR_CHARS) * some,
        np.where(upper + lower > 0, upper / np.maximum(upper + lower, 1), 0),
        np.bincount(doc, weights=capital, minlength=docs) / n,
        (np.bincount(doc, weights=repeats(w.h, doc, WORD_WINDOW), minlength=docs) + 0.3 * PRIOR_WORDS) / (words + PRIOR_WORDS) * some,
        (np.bincount(doc[at], weights=repeats(pairs, doc[at], PAIR_WINDOW), minlength=docs) + 0.05 * PRIOR_WORDS) / (words + PRIOR_WORDS) * some,
        same_line,
        np.maximum(0, 1 - (12 * stops + PRIOR_WORDS) / (words + PRIOR_WORDS)) * some,
        np.where(words < 1, 1.0, 0.0),
    ], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    bad, good = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    return np.where(stats > bad, BAD, np.where(stats <= good, GOOD, NONE))


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def unpack(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, P(vote | class) as labeller x class x vote, classes bad and good).

    There are several ways to be bad, one for each labeller at the start, and one to be good. All
    their shares and all votes' rates are estimated; the rates given back pool the bad classes.
    """
    v, many = unpack(pattern), len(LABELLERS)
    bad = v == BAD
    weight = np.column_stack([bad / np.maximum(bad.sum(axis=1), 1)[:, None], ~bad.any(axis=1)]) * 0.9 + 0.1 / (many + 1)
    weight /= weight.sum(axis=1, keepdims=True)
    votes_of = [np.stack([v == x for x in (BAD, GOOD, NONE)], axis=2)[:, k] for k in range(many)]
    for _ in range(rounds):
        n = weight * count[:, None]
        prior = (n.sum(axis=0) + 1) / (n.sum() + many + 1)
        log = np.repeat(np.log(prior)[None, :], len(v), axis=0)
        for k in range(many):
            rate = n.T @ votes_of[k] + 0.5
            log += votes_of[k] @ np.log(rate / rate.sum(axis=1, keepdims=True)).T
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - weight).max() < 1e-9 if len(v) else True
        weight = new
        if done:
            break
    n = np.column_stack([weight[:, :-1].sum(axis=1), weight[:, -1]]) * count[:, None]
    table = np.stack([n.T @ votes_of[k] + 0.5 for k in range(many)])
    return weight[:, -1], table / table.sum(axis=2, keepdims=True)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its form): form is first and last byte class, length, and whether it repeats the word before."""
    last = w.data[w.end - 1] if len(w.h) else np.zeros(0, np.uint8)
    first = w.data[w.start] if len(w.h) else np.zeros(0, np.uint8)
    kind = np.zeros(256, np.uint64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[list(b".,;:")], kind[list(b"!?")], kind[list(b"#*$%&|<>")] = 5, 6, 7
    again = np.zeros(len(w.h), np.uint64)
    again[1:] = w.h[1:] == w.h[:-1]
    form = kind[first] + np.uint64(8) * kind[last] + np.uint64(64) * np.minimum(w.end - w.start, 15).astype(np.uint64) + np.uint64(1024) * again
    return (w.h >> np.uint64(64 - BITS)).astype(np.int64), form.astype(np.int64)


def bins(stats: np.ndarray) -> np.ndarray:
    """Documents x labellers: one of eight cells of each statistic."""
    return np.minimum((stats * 8).astype(np.int64), 7) + 8 * np.arange(len(LABELLERS))


def train(texts: list[str], posterior: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    model = {"word": np.zeros(1 << BITS), "form": np.zeros(2048), "bin": np.zeros(8 * len(LABELLERS)), "bias": 0.0}
    rows = []
    for t in texts:
        w = W.words(*W.utf8(pa.array([t])))
        b, f = features(w)
        n = max(1, len(b))
        ub, cb = np.unique(b, return_counts=True)
        uf, cf = np.unique(f, return_counts=True)
        rows.append((ub, cb / n, uf, cf / n, bins(statistics(w))[0]))
    share = np.array([1 - posterior.mean(), posterior.mean()])
    for e in range(epochs):
        lr = rate * (1 - e / epochs)
        for i in rng.permutation(len(rows)):
            ub, cb, uf, cf, k = rows[i]
            z = model["bias"] + cb @ model["word"][ub] + cf @ model["form"][uf] + model["bin"][k].sum()
            y = posterior[i]
            g = lr * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * 0.5 / max(0.05, share[int(y > 0.5)])
            model["word"][ub] -= g * 2 * cb
            model["form"][uf] -= g * 4 * cf
            model["bin"][k] -= g * 0.3
            model["bias"] -= g * 0.3
    return model


def quality_scores(w: W.Words, stats: np.ndarray, model: dict) -> np.ndarray:
    b, f = features(w)
    c = np.zeros(len(b) + 1)
    np.cumsum(model["word"][b] + model["form"][f], out=c[1:])
    z = model["bias"] + np.diff(c[w.ptr]) / np.maximum(np.diff(w.ptr), 1) + model["bin"][bins(stats)].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _toxic_keys(w: W.Words) -> list[np.ndarray]:
    """Per word: hash of its letters and of its beginnings of 4, 5 and 6 bytes (0 where shorter)."""
    out = []
    if not len(w.h):
        return [np.zeros(0, np.uint64)] * 4
    trail = np.isin(w.data[w.end - 1], np.frombuffer(b".,;:!?", np.uint8)) & (w.end - w.start > 1)
    end = w.end - trail
    out.append(W.word_hashes(w.data, w.start, end))
    for size in (4, 5, 6):
        ok = end - w.start > size
        out.append(np.where(ok, W.mix(W.word_hashes(w.data, w.start, np.minimum(w.start + size, end)) + np.uint64(size)), np.uint64(0)))
    return out


def train_toxic(texts: list[str], toxic: np.ndarray) -> dict:
    """Keys that enough toxic texts and hardly any clean ones have; equal texts count once."""
    keys, docs, seen = [], [], {}
    for t, y in zip(texts, toxic, strict=True):
        seen.setdefault(t, int(y))
    for i, t in enumerate(seen):
        w = W.words(*W.utf8(pa.array([t])), fold=W.LOWER)
        k = np.unique(np.concatenate(_toxic_keys(w)))
        keys.append(k)
        docs.append(np.full(len(k), i))
    y = np.array(list(seen.values()), bool)
    if not len(y) or not y.any():
        return {"keys": np.zeros(0, np.uint64), "odds": np.zeros(0)}
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    flag = y[np.concatenate(docs)]
    bad, clean = np.bincount(back, weights=flag), np.bincount(back, weights=~flag)
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((~y).sum() + 1))
    use = (bad >= MIN_TOXIC_TEXTS) & (odds >= MIN_ODDS) & (bad >= 20 * clean) & (key != 0)
    return {"keys": key[use], "odds": odds[use]}


def toxic_scores(w: W.Words, model: dict) -> np.ndarray:
    """Largest log-odds of a document's words, 0 if none counts."""
    out, doc = np.zeros(len(w.ptr) - 1), w.doc
    for key in _toxic_keys(w):
        at = W.lookup(model["keys"], key)
        hit = np.flatnonzero(at >= 0)
        np.maximum.at(out, doc[hit], model["odds"][at[hit]])
    return out


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = W.utf8(batch.column(0))
        got = [patterns(votes(statistics(W.words(data[off[i] : off[j]], off[i : j + 1] - off[i])))) for i, j in W.runs(off)]
        p, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["p", "n"])


def _one_task(rows: DataFrame, fit) -> dict | None:
    """Run ``fit`` over a bounded sample inside one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))], pa.binary())], names=["model"])

    out = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(out[0]["model"])) if out else None


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, toxic_rows: int = TOXIC_ROWS) -> dict:
    """Both scorers and the labellers' accuracies. ``labels`` has doc_id and toxic; quality labels are not used."""
    counted = docs.select("text").mapInArrow(W.tidied(_count_patterns), "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).toArrow().sort_by("p")
    pattern, count = counted["p"].to_numpy(), counted["n"].to_numpy()
    good, table = expectation_maximisation(pattern, count)
    total, labelled = int(count.sum()), labels.where("toxic is not null and doc_id is not null").count()

    def ticket(seed: int, rows: int, of: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < F.lit(-(-1_000_000 * min(rows, max(of, 1)) // max(of, 1)))

    def fit(rows: list[tuple]) -> dict:
        texts = [r[1] for r in rows]
        p = patterns(np.concatenate([votes(statistics(W.words(*W.utf8(pa.array([t]))))) for t in texts]))
        return train(texts, good[np.searchsorted(pattern, p)])

    model = _one_task(docs.where("text is not null").select("doc_id", "text").where(ticket(5, sample_rows, total)).where("doc_id is not null"), fit)
    some = labels.where("toxic is not null and doc_id is not null").where(ticket(6, toxic_rows, labelled)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    toxic = _one_task(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id"), lambda rows: train_toxic([r[1] for r in rows], np.array([r[2] for r in rows])))
    return {"quality": model, "toxic": toxic, "accuracy": {x[0]: table[k, [0, 1], [BAD, GOOD]].tolist() for k, x in enumerate(LABELLERS)}}


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality, toxicity, kept, toxic, clean), one row for each row of ``docs``.

    quality is the scorer's probability of good; kept: it reaches the threshold. toxicity is the largest
    log-odds of a word (0: none), toxic tells whether there is one; clean: kept and not toxic. Text that is null or has no
    word has quality 0. Without a trained scorer quality is 1 for others. Repeated rows score alike;
    no rows give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = W.utf8(batch.column(1))
            q, x = [np.zeros(0)], [np.zeros(0)]
            for i, j in W.runs(off):
                part, ptr = data[off[i] : off[j]], off[i : j + 1] - off[i]
                w = W.words(part, ptr)
                has = np.diff(w.ptr) > 0
                q.append(np.where(has, quality_scores(w, statistics(w), m["quality"]) if m["quality"] else 1.0, 0.0))
                x.append(toxic_scores(W.words(part, ptr, fold=W.LOWER), m["toxic"]) if m["toxic"] else np.zeros(len(has)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(q)), pa.array(np.concatenate(x))], names=["doc_id", "quality", "toxicity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(W.tidied(score), f"doc_id {kind}, quality double, toxicity double")
    return out.withColumns({"kept": F.col("quality") >= threshold, "toxic": F.col("toxicity") > 0}).withColumn("clean", F.expr("kept and not toxic"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

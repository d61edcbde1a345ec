"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams (hashed into 2**BUCKETS rows); a
linear layer and a softmax over it give the language. Both are trained together by stochastic
gradient descent in numpy, inside one task, on a bounded sample of labelled rows. One more class stands
for no known language: its rows are sample texts with their characters shuffled. On rows kept out of the
descent a temperature is fitted, shuffled ones among them, and the rejection threshold: an answer needs
the confidence ``ENOUGH``, or less if that would cost more than ``CLEAN_LOSS`` of the clean rows. As everything up to the softmax is linear, the
trained model is one small table (bucket x language) that is broadcast and summed over texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.llm import wordhash as W

BUCKETS, DIM, GRAMS = 15, 16, (3, 4)
#: rows of the training sample at most, in expectation; shared evenly by the languages
SAMPLE_ROWS = 6000
#: languages that one model may have; more are refused
MAX_LANGUAGES = 500
#: share of clean calibration rows that the rejection threshold may cost at most; least confidence that is enough for any text
CLEAN_LOSS, ENOUGH = 0.001, 0.5
#: characters of a stretch of a text that makes a shuffled row of the training sample
SHUFFLED = 4000
#: places of a text whose grams are looked up at once
PART = 1 << 18
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def grams(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the gram that starts at each byte, whether it lies in one document)."""
    n = len(data)
    if n < size:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    x = np.zeros(n, np.uint32)
    for k in range(size):
        x[: n - k] = (x[: n - k] + data[k:]) * np.uint32(0x01000193)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    ok = np.ones(n, bool)
    for k in range(1, size):  # the last size - 1 places of every document
        at = off[1:] - k
        ok[at[at >= 0]] = False
    return (x >> np.uint32(32 - BUCKETS)).astype(np.int64), ok


def logits(data: np.ndarray, off: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Documents x languages; what is held beside them does not depend on the length of a document."""
    docs, langs = len(off) - 1, table.shape[1]
    total, count = np.zeros((docs, langs)), np.zeros(docs)
    for s in range(0, len(data), PART):
        e = min(s + PART, len(data))
        i, j = int(np.searchsorted(off, s, side="right")) - 1, int(np.searchsorted(off, e))  # the documents with bytes in s:e
        at, c = np.clip(off[i : j + 1], s, e) - s, np.zeros(e - s + 1)
        for size in GRAMS:
            part = data[s : e + size - 1]  # the last grams reach into the next part
            bucket, ok = grams(part, np.clip(off[i : j + 1] - s, 0, len(part)), size)
            bucket, ok = np.where(ok, bucket, 1 << BUCKETS)[: e - s], ok[: e - s]  # an extra row of zeros
            for k in range(langs):
                np.cumsum(table[:, k][bucket], out=c[1:])
                total[i:j, k] += np.diff(c[at])
            np.cumsum(ok, out=c[1:])
            count[i:j] += np.diff(c[at])
    return total / np.maximum(count, 1)[:, None] + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags(texts: list[str], rng: np.random.Generator | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text, in as few bytes as they need; with a generator also of short stretches of its words."""
    out = []
    for text in texts:
        some = [text]
        if rng is not None:
            ws = text.split()
            for size in (6, 20):
                at = int(rng.integers(0, max(1, len(ws) - size)))
                some.append(" ".join(ws[at : at + size]))
        for t in some:
            data, off = W.utf8(pa.array([t]))
            got = []
            for size in GRAMS:
                bucket, ok = grams(W.LOWER[data], off, size)
                got.append(bucket[ok])
            b, c = np.unique(np.concatenate(got), return_counts=True)
            out.append((b.astype(np.min_scalar_type((1 << BUCKETS) - 1)), c.astype(np.min_scalar_type(int(c.max(initial=0))))))
    return out


def shuffled(text: str, rng: np.random.Generator) -> str:
    """Its characters but white space in another order."""
    chars = np.array(list(text))
    at = np.flatnonzero([not c.isspace() for c in chars])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars)


def train(texts: list[str], langs: list[str], enough: float = ENOUGH, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> dict:
    """Fit the model; a fifth of the rows fits the temperature and the threshold. The last class is that of no language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    other = rng.permutation(len(texts))[: max(1, len(texts) // (2 * len(names) + 1))]
    y = np.array([names.index(x) for x in langs] + [len(names)] * len(other))
    starts = [int(rng.integers(max(1, len(texts[i]) - SHUFFLED + 1))) for i in other]
    texts = texts + [shuffled(texts[i][s : s + SHUFFLED], rng) for i, s in zip(other, starts)]
    turn = rng.permutation(len(texts))
    cut = max(1, len(texts) // 5) if len(texts) >= 10 else 0
    calib, fit = turn[:cut], turn[cut:]
    xs, ys = bags([texts[i] for i in fit], rng), np.repeat(y[fit], 3)
    emb = rng.normal(0, 0.1, (1 << BUCKETS, DIM)).astype(np.float32)
    classes = len(names) + 1
    lin, bias = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32), np.zeros(classes, np.float32)
    step, steps = 0, max(1, epochs * len(xs))
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            b, c = xs[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            if not len(b):
                continue
            c = (c / c.sum()).astype(np.float32)
            mean = c @ emb[b]
            p = softmax((mean @ lin + bias)[None, :])[0]
            p[ys[i]] -= 1
            back = lin @ p
            lin -= lr * np.outer(mean, p)
            bias -= lr * p
            emb[b] -= (lr * 50) * np.outer(c, back)
    table = np.vstack([emb @ lin, np.zeros((1, classes), np.float32)]).astype(np.float64)
    model = {"names": names, "table": table, "bias": bias.astype(np.float64), "temperature": 1.0, "threshold": 0.0}
    if len(calib):
        data, off = W.utf8(pa.array([texts[i] for i in calib]))
        raw = logits(W.LOWER[data], off, table, model["bias"])
        loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(calib)), y[calib]], 1e-12)).mean()
        model["temperature"] = float(min(np.geomspace(0.1, 10, 60), key=loss))
        clean = y[calib] < len(names)
        sure = softmax(raw[clean] / model["temperature"])[:, :-1].max(axis=1)
        if len(sure) * CLEAN_LOSS >= 1:  # fewer rows can't tell so small a share; the class of no language decides alone
            model["threshold"] = float(min(enough, np.quantile(sure, CLEAN_LOSS, method="lower")))
    return model


def _with_letter(data: np.ndarray, off: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Documents with a letter of any script; only those without an ASCII one are looked at as text."""
    out = np.zeros(len(off) - 1, bool)
    for i, j in W.runs(off):
        part = data[off[i] : off[j]]
        c = np.zeros(len(part) + 1, np.int32)
        np.cumsum((part >= 97) & (part <= 122), out=c[1:])
        out[i:j] = np.diff(c[off[i : j + 1] - off[i]]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = _letter.search(texts[i].as_py()) is not None
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> dict:
    """Train on a hash sample of the rows whose crc32(doc_id) mod 5 is not 0, about ``sample_rows``.

    The sample is shared evenly by the languages; more than ``max_languages`` are an error, none is left
    out. Rows without an id, a language or a text are not used. No usable rows: a model without languages.
    """
    spark = docs.sparkSession
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, and sample_rows with it")
    rates = [F.lit(x) for r in counts for x in (r["lang"], -(-1_000_000 * min(r["count"], sample_rows // len(counts) + 1) // r["count"]))]
    rate = F.create_map(*rates)[F.col("lang")] if rates else F.lit(0)
    ticket = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    sample = usable.select("doc_id", "lang", "text").where(ticket < F.coalesce(rate, F.lit(0)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, lang, text) for b in batches for i, lang, text in zip(*[c.to_pylist() for c in b.columns], strict=True) if _letter.search(text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2] for r in rows], [r[1] for r in rows]))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(W.tidied(fit), "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else {"names": [], "table": np.zeros(((1 << BUCKETS) + 1, 1)), "bias": np.zeros(1), "temperature": 1.0, "threshold": 0.0}


def predict_languages(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id), lang_pred, score and rejected; one row for each row.

    ``und`` (score 0, rejected) for null text, text without a letter, or a model without languages;
    otherwise the likeliest language and its calibrated probability, rejected below the threshold or if no language
    at all is likelier.
    Only ``text`` is looked at. Repeated rows get the same answer.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = keep.index("text") if "text" in keep else len(keep)  # texts go to Python once

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = W.utf8(batch.column(text))
            letters = np.zeros(len(off) - 1, bool)
            names, scores, other = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.zeros(len(letters))
            if m["names"]:
                for i, j in W.runs(off):
                    part, at = W.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
                    letters[i:j] = _with_letter(part, at, batch.column(text).slice(i, j - i))
                    p = softmax(logits(part, at, m["table"], m["bias"]) / m["temperature"])
                    p, other[i:j] = p[:, :-1], p[:, -1]
                    names[i:j], scores[i:j] = np.array(m["names"], object)[p.argmax(axis=1)], p.max(axis=1)
                names[~letters], scores[~letters] = UNKNOWN, 0.0
            rejected = (names == UNKNOWN) | (other > scores) | (scores < m["threshold"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(rejected.astype(bool))], names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col("text").alias("t")] * (text == len(keep)))
    out = rows.mapInArrow(W.tidied(predict), ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], "lang_pred string, score double, rejected boolean"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(docs, fit_languages(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

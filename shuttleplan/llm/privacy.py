"""Personal data: fixed patterns, secrets, and terms that give a protected entity away.

Protected entities are what the patterns find (email, ip, card, phone) and secrets: long mixed runs of
letters and digits whose characters carry ``SECRET_BITS`` of information at least. An entity stands at
three levels, and a level with too few occurrences to judge backs off to the next: its value, its
generalisation (an e-mail's domain, an ip's first two numbers, the leading digits of a card or phone
number) and its kind.

Of every level's entities Spark counts over the whole corpus in how many documents they occur, and in
how many of a term's documents the term stands near them. With p(e) and p(e | t), the latter by the
lower end of its confidence interval, term t tells log2(p(e | t) / p(e)) of the -log2 p(e) bits that
name e: the ratio is the term's disclosure, 1 if it determines the entity. From ``REMOVE`` on a term is
removed wherever it occurs; from ``GENERALISE`` on it is generalised to its shape.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.llm import wordhash as W

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term_removed", "term_generalised")
#: fixed patterns of the contract. Each is written so that a scan is linear: an email is found from its @, an ip from the first digit of a run
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
TURN = re.compile(r"[0-9][A-Za-z]|[A-Za-z](?=[0-9])")
#: information of a secret's characters; changes between letters and digits in it
SECRET_BITS, SECRET_TURNS = 64.0, 4
#: words looked at on each side of an entity; different contexts that a term needs; its least length in bytes; confidence in standard errors
REACH, MIN_CONTEXTS, MIN_TERM_BYTES, SURE = 6, 3, 4, 2.0
GENERALISE, REMOVE = 0.6, 0.9
FILTER_BITS = 1 << 23
#: disclosing terms that one broadcast holds at most; more are applied block after block
BLOCK_TERMS = 1_000_000
SPANS = "array<struct<kind:string,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def genuine(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in found.split(".")))
    digits = "".join(c for c in found if "0" <= c <= "9") if kind in ("card", "phone") else ""
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[str, int, int]]:
    """What comes before an @ belongs to it as far back as its characters allow."""
    out, last = [], 0
    for m in PATTERNS["email"].finditer(text):
        a = m.start()
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            last = m.end()
            out.append(("email", a, last))
    return out


def base_spans(text: str, kinds: tuple[str, ...] = BASE) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping per kind; a match that fails its check is dropped, not retried."""
    out = emails(text) if "email" in kinds else []
    return out + [(k, m.start(), m.end()) for k in kinds if k != "email" for m in PATTERNS[k].finditer(text) if genuine(k, m.group())]


def secret_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that are too informative to be words, outside the emails found."""
    out = []
    for m in SECRET.finditer(text):
        run = m.group()
        if len(TURN.findall(run)) >= SECRET_TURNS and not any(k == "email" and a < m.end() and m.start() < b for k, a, b in taken):
            n = np.array(list(Counter(run).values()))
            if float((n * np.log2(len(run) / n)).sum()) >= SECRET_BITS:
                out.append(("secret", m.start(), m.end()))
    return out


def coarse(kind: str, value: str) -> str:
    """The generalisation of an entity."""
    if kind == "email":
        return value.split("@")[1].lower()
    if kind == "ip":
        return ".".join(value.split(".")[:2])
    digits = "".join(c for c in value if "0" <= c <= "9")
    return digits[: 6 if kind == "card" else 4] if kind in ("card", "phone") else value[:4]


def shape(word: str) -> str:
    """A term without its letters: what a generalised term is replaced by."""
    return "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in word)


def _possible(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with an @, and documents with a digit."""
    out = []
    for flag in (data == 64, W.DIGIT[data]):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=c[1:])
        out.append(np.diff(c[off]) > 0)
    return out[0], out[1]


def _entities(texts: pa.Array) -> list[list[dict]]:
    """Spans of patterns and secrets in every text."""
    at, digit = _possible(*W.utf8(texts))
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(at | digit):
        text = texts[int(i)].as_py() or ""
        found = base_spans(text, (("email",) if at[i] else ()) + (BASE[1:] if digit[i] else ()))
        if digit[i]:
            found += secret_spans(text, found)
        spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
    return spans


def _spans_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _key(name: str) -> int:
    return int(W.word_hashes(np.frombuffer(name.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(name.encode())])).view(np.int64)[0])


def _contexts(batches: Iterator[pa.RecordBatch], reach: int = REACH) -> Iterator[pa.RecordBatch]:
    """(level, entity, context, term), once a document, for the words around its entities; term 0 stands for the document itself.

    Contexts are told apart by their words, so that copies of one text are one.
    """
    for batch in batches:
        texts = batch.column(0)
        rows: list[tuple[int, int, int, int]] = []
        for i, own in enumerate(_entities(texts)):
            if not own:
                continue
            text = texts[i].as_py()
            w = W.words(*W.utf8(pa.array([text])), fold=W.LOWER)
            term = _terms(w)
            byte = np.append(np.flatnonzero((w.data & 0xC0) != 0x80), len(w.data))  # of every code point
            whole = int(W.mix(np.array([w.h.sum()], np.uint64)).view(np.int64)[0])
            seen: set[tuple[int, int, int, int]] = set()
            for s in own:
                value = text[s["start"] : s["end"]]
                keys = [(0, _key(f"{s['kind']} {value}")), (1, _key(f"{s['kind']} of {coarse(s['kind'], value)}")), (2, _key(s["kind"]))]
                lo, hi = int(np.searchsorted(w.end, byte[s["start"]], "right")), int(np.searchsorted(w.start, byte[s["end"]]))
                near = np.r_[np.arange(max(0, lo - reach), lo), np.arange(hi, min(len(w.h), hi + reach))]
                context = int(W.mix(np.array([w.h[near].sum()], np.uint64)).view(np.int64)[0])
                terms = w.h[near][term[near]].view(np.int64).tolist()
                seen |= {(k, e, context, t) for k, e in keys for t in terms} | {(k, e, whole, 0) for k, e in keys}
            rows += seen
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["level", "entity", "context", "term"])


def _terms(w: W.Words) -> np.ndarray:
    """Words that can be terms: long enough, without digits or @."""
    bad = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(W.DIGIT[w.data] | (w.data == 64), out=bad[1:])
    return (bad[w.end] == bad[w.start]) & (w.end - w.start >= MIN_TERM_BYTES)


def _frequencies(bitmap: bytes):
    """(term, documents) of the batch for terms in the bitmap, aggregated before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            data, off = W.utf8(batch.column(0))
            got = []
            for i, j in W.runs(off):
                w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i], fold=W.LOWER)
                place = (w.h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
                if len(hit):
                    pairs = np.unique(np.stack([w.h[hit], w.doc[hit].astype(np.uint64)]), axis=1)
                    got.append(pairs[0])
            term, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return count


def _at_least(k: Column, n: Column, sure: float) -> Column:
    """Lower end of Wilson's interval for a share of k in n."""
    z, p = sure * sure, k / n
    return (p + z / (2 * n) - sure * F.sqrt((p * (1 - p) + z / (4 * n)) / n)) / (1 + z / n)


def disclosures(rows: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE, sure: float = SURE, reach: int = REACH) -> DataFrame:
    """(level, entity, term, contexts, together, n_term, n_entity, share, bits, disclosure) of the pairs from the threshold on.

    ``rows`` has text. Terms and entities are 64-bit hashes; level is 0 for values, 1 for their
    generalisations, 2 for kinds. ``contexts`` counts the different word contexts in which the two
    meet, so copies of one text count once; ``together``, ``n_term`` and ``n_entity`` count documents.
    Entities that every document holds name nothing and are left out.
    """
    met = rows.select("text").mapInArrow(W.tidied(partial(_contexts, reach=reach)), "level int, entity bigint, context bigint, term bigint")
    met = materialize(met.groupBy("level", "entity", "context", "term").agg(F.count("*").alias("n")))
    pairs = met.where("term <> 0").groupBy("level", "entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("together"))
    pairs = materialize(pairs.where(F.col("contexts") >= min_contexts))
    entities = met.where("term = 0").groupBy("level", "entity").agg(F.sum("n").alias("n_entity"))
    # a filter of fixed size keeps other words out of the count of documents; it admits some, the join drops them
    place = F.expr(f"term & {FILTER_BITS - 1}L")
    words = pairs.select("term").distinct().groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(term & {FILTER_BITS - 1}L & 7 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[words["byte"].to_numpy()] = words["bits"].to_numpy().astype(np.uint8)
    df = rows.select("text").mapInArrow(W.tidied(_frequencies(bitmap.tobytes())), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = float(rows.count())
    joined = pairs.join(df, "term").join(entities, ["level", "entity"]).where(F.col("n_entity") < total)
    share = _at_least(F.least("together", "n_term").cast("double"), F.col("n_term").cast("double"), sure)
    joined = joined.withColumn("share", share).withColumn("bits", F.log2(F.col("share") * total / F.col("n_entity")))
    joined = joined.withColumn("disclosure", F.col("bits") / F.log2(total / F.col("n_entity")))
    return joined.where(F.col("disclosure") >= generalise).select("level", "entity", "term", "contexts", "together", "n_term", "n_entity", "share", "bits", "disclosure")


def _mark(terms: bytes, removed: bytes, first: bool, last: bool):
    """Adds the spans of a block of terms. The columns end with the text and, after the first block, the spans so far."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gone = np.frombuffer(terms, np.uint64), np.frombuffer(removed, bool)
        for batch in batches:
            texts = batch.column(batch.num_columns - (1 if first else 2))
            spans = _entities(texts) if first else batch.column(batch.num_columns - 1).to_pylist()
            data, off = W.utf8(texts)
            for i, j in W.runs(off) if len(known) else ():
                w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i], fold=W.LOWER)
                at = W.lookup(known, w.h)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    c = np.zeros(len(w.data) + 1, np.int64)
                    np.cumsum((w.data & 0xC0) != 0x80, out=c[1:])
                    start = c[w.off]
                    for d, a, b, g in zip(w.doc[hit].tolist(), c[w.start[hit]].tolist(), c[w.end[hit]].tolist(), gone[at[hit]].tolist(), strict=True):
                        spans[i + d].append({"kind": "term_removed" if g else "term_generalised", "start": a - int(start[d]), "end": b - int(start[d])})
            keep = batch.columns[: batch.num_columns - (1 if first else 2)] + ([] if last else [texts])
            yield pa.RecordBatch.from_arrays([*keep, pa.array(spans, _spans_type())], names=[*[f"c{i}" for i in range(len(keep))], "spans"])

    return mark


def find_personal_data(
    docs: DataFrame,
    keep: list[str] | None = None,
    block_terms: int = BLOCK_TERMS,
    min_contexts: int = MIN_CONTEXTS,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """The columns ``keep`` (default doc_id) and spans (kind, start, end in code points).

    Spans are sorted by kind as in KINDS, then start. Null text has none. Repeated rows are marked
    alike and count as often as they occur; no rows give no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text"))
    telling = materialize(disclosures(rows, min_contexts, generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    blocks, found = max(1, -(-telling.count() // block_terms)), rows
    for b in range(blocks):
        own = telling.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).toArrow()
        terms = own["term"].to_numpy().view(np.uint64)
        rank = np.argsort(terms)
        last = b == blocks - 1
        fields = [f"c{i} {t}" for i, t in enumerate(kinds)] + ([] if last else [f"c{len(keep)} string"]) + [f"spans {SPANS}"]
        mark = _mark(terms[rank].tobytes(), (own["disclosure"].to_numpy()[rank] >= remove).tobytes(), b == 0, last)
        found = found.mapInArrow(W.tidied(mark), ", ".join(fields))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], spans.alias("spans"))


def redact(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with entities replaced by their kind in brackets, terms removed or generalised; of overlapping spans the first holds."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= at:
            found = text[s["start"] : s["end"]]
            out += [text[at : s["start"]], "" if s["kind"] == "term_removed" else shape(found) if s["kind"] == "term_generalised" else f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns
        cut = [redact(t, s) for t, s in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(cut, pa.string()), batch.column(n - 1)], names=batch.schema.names)


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """All columns of ``docs`` with the text sanitised, and spans (in the old text); a column named spans is replaced.

    ``settings`` are those of ``find_personal_data``; null text stays null.
    """
    names = [c for c in docs.columns if c not in ("text", "spans")] + ["text"]
    found = find_personal_data(docs, keep=names, **settings)
    plain = [f"c{i} {found.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + [f"spans {SPANS}"]
    out = found.toDF(*[f"c{i}" for i in range(len(names))], "spans").mapInArrow(W.tidied(_redacted), ", ".join(plain)).toDF(*names, "spans")
    return out.select(*[c for c in docs.columns if c != "spans"], "spans")


def _joined(kinds: tuple[str, ...]) -> Column:
    own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``personal`` tells documents with an entity or a secret; terms alone do not make a document personal."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(*kinds: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("bigint")

    counts = [count(k).alias(f"n_{k}") for k in KINDS[:5]]
    base, whole = F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans")
    return found.select("doc_id", *counts[:4], base, whole, counts[4], count(*KINDS[5:]).alias("n_terms"), (count(*KINDS[:5]) > 0).alias("personal"))

"""Line dedup with a tree of log templates.

Every line is parsed to a fixed depth: its token count, its first ``LEAD`` tokens (tokens with a
digit count as a field), then a leaf. In a leaf a line has a template with its fields masked, and
``SPANS`` more in which one stretch of its remaining tokens is masked too, so lines that differ in
one variable stretch share a template; a line with fields has itself as one more. The more tokens a
template fixes, the fewer documents it takes to be boilerplate (``NEED``): a long passage is a copy
wherever it recurs, a short line may recur by chance. Lines of boilerplate are dropped everywhere
but in the first document.

Only hashes of lines move. Leaves with too few lines are cut off before templates are counted;
counting combines on the map side, so a line that a third of all documents has is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.llm import wordhash as W

LEAD, SPANS, SALTS = 4, 3, 16
#: (fixed tokens at least, documents at least) of a recurring template; the lowest two bits of a key hold the place here
NEED = ((20, 2), (4, 5), (0, 20))
FIXED = np.array([k for k, _ in NEED])


def _ranked(keys: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Keys with the place in NEED of what they fix; equal templates fix equally many tokens."""
    return (keys & ~np.uint64(3)) | (fixed[:, None] < FIXED).sum(axis=1).astype(np.uint64)


def _need(key: str, min_docs: int | None) -> Column:
    """Documents from which the template or leaf of this key recurs."""
    if min_docs is not None:
        return F.lit(min_docs)
    return F.element_at(F.array(*[F.lit(n) for _, n in NEED]), (F.col(key).bitwiseAND(F.lit(3)) + 1).cast("int"))


def _salt(row: str) -> Column:
    return F.pmod(F.col(row), F.lit(SALTS)).cast("int")


def _salted(keys: DataFrame) -> DataFrame:
    """One row for each salt: the lines of a hot leaf or template are joined in several tasks."""
    return keys.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _cut_lines(batches: Iterator[pa.RecordBatch], min_tokens: int = 1) -> Iterator[pa.RecordBatch]:
    """(r, doc_id, line, leaf, templates) of every line with ``min_tokens`` tokens."""
    for batch in batches:
        r, ids = batch.column(0), batch.column(1)
        data, off = W.utf8(batch.column(2))
        for i, j in W.runs(off):
            w = W.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = len(w.h)
            if not n:
                continue
            digits, breaks = np.zeros(len(w.data) + 1, np.int64), np.zeros(len(w.data) + 1, np.int64)
            np.cumsum(W.DIGIT[w.data], out=digits[1:])
            np.cumsum(w.data == 10, out=breaks[1:])
            field = digits[w.end] > digits[w.start]
            token = np.where(field, np.uint64(0x2545F4914F6CDD1D), w.h)
            plain = np.zeros(n + 1, np.int64)
            np.cumsum(~field, out=plain[1:])
            doc = w.doc
            line = breaks[w.start] - breaks[w.off[doc]]
            head = np.ones(n, bool)
            head[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
            s = np.flatnonzero(head)
            e = np.append(s[1:], n)
            long = e - s >= min_tokens
            s, e = s[long], e[long]
            seq, size = W.Sequences(token), e - s
            lead = np.minimum(s + LEAD, e)
            leaf = W.mix(seq.of(s, lead) ^ W.mix(size.astype(np.uint64)))
            fixed = plain[e] - plain[s]
            keys = [_ranked(W.mix(leaf ^ seq.of(lead, e)), fixed)]
            for k in range(SPANS):  # masked: a third of what follows the leading tokens
                a, b = lead + (e - lead) * k // SPANS, lead + (e - lead) * (k + 1) // SPANS
                masked = W.mix(leaf ^ W.mix(seq.of(lead, a) + np.uint64(k + 1)) ^ (seq.of(b, e) * np.uint64(3)))
                keys.append(np.where((b > a) & (size >= 2 * LEAD), _ranked(masked, fixed - plain[b] + plain[a]), keys[0]))
            exact = W.mix(leaf ^ W.mix(W.Sequences(w.h).of(s, e) + np.uint64(SPANS + 1)))
            keys.append(np.where(fixed < size, _ranked(exact, size), keys[0]))
            leaf = _ranked(leaf, size)
            at = pa.array(i + doc[s])
            flat = np.stack(keys, axis=1).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(keys), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([r.take(at), ids.take(at), pa.array(line[s].astype(np.int32)), pa.array(leaf.view(np.int64)), lists], names=["r", "doc_id", "line", "leaf", "templates"])


def drop_templates(docs: DataFrame, min_docs: int | None = None, min_tokens: int = 1) -> DataFrame:
    """All columns of ``docs`` with ``text`` without recurring lines, plus n_lines and n_dropped.

    A line is dropped if one of its templates occurs in as many documents as NEED says for the tokens
    it fixes, and this document is not the first of them (least doc_id; a null doc_id comes last).
    With ``min_docs`` that count holds for all templates instead; lines below ``min_tokens`` tokens stay. Lines are split at the newline character, those left are joined by it.
    Null text stays null with 0 lines. Equal rows (id and text) count as one document and are treated
    alike; no rows give no rows; columns named n_lines or n_dropped are replaced.
    """
    base = docs.drop("n_lines", "n_dropped")
    keyed = base.withColumn("_r", F.xxhash64("doc_id", "text"))
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    cut = partial(_cut_lines, min_tokens=min_tokens)
    found = keyed.select("_r", order.alias("doc_id"), "text").mapInArrow(W.tidied(cut), "r bigint, doc_id bigint, line int, leaf bigint, templates array<bigint>")
    lines = materialize(found)
    common = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= _need("leaf", min_docs)).select("leaf")
    near = lines.withColumn("s", _salt("r")).join(_salted(common), ["leaf", "s"]).select("r", "doc_id", "line", F.explode(F.array_distinct("templates")).alias("t"))
    near = materialize(near)
    recurring = near.groupBy("t", "r").agg(F.min("doc_id").alias("doc_id")).groupBy("t").agg(F.count("*").alias("docs"), F.min("doc_id").alias("d"))
    recurring = recurring.where(F.col("docs") >= _need("t", min_docs))
    lead = near.join(recurring.select("t", F.col("d").alias("doc_id")), ["t", "doc_id"], "left_semi").groupBy("t").agg(F.min("r").alias("lead"))
    gone = near.withColumn("s", _salt("r")).join(_salted(recurring.select("t").join(lead, "t")), ["t", "s"]).where("r <> lead").groupBy(F.col("r").alias("_r")).agg(F.collect_set("line").alias("_gone"))
    out = keyed.join(gone, "_r", "left")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains("_gone", i))
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in base.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

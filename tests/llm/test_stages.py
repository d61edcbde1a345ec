"""Pipeline stages on edge rows: columns with the library's own names, nulls, empty tables, repeated rows, a long text."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline as P
from shuttleplan.llm import decontaminate, language, packing
from shuttleplan.llm import wordhash as W

SF = "/root/testdata/sf0.001"
NAMES = ["score", "rejected", "lang_pred", "n_words", "spans", "item_ids", "n_hit", "_r", "_gone", "keys", "own", "best", "component_id", "n_dropped", "a.b", "carried"]
STAGES = [s for s in P.STAGES if s[0] != "best_fit_packing"]


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_other_columns_pass_through(spark, name, stage):
    docs = spark.createDataFrame(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    value = lambda k: F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string"))
    more = docs.select("*", *[value(k).alias(c) for k, c in enumerate(NAMES)])
    plain, out = stage(spark, docs, SF), stage(spark, more, SF)
    assert out.columns == more.columns
    rows = out.collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in rows) == sorted((r.doc_id, r.text, r.lang) for r in plain.collect()) and rows
    assert all(r[c] == f"{k}-{r.doc_id}"  for r in rows for k, c in enumerate(NAMES))


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_edge_rows(spark, name, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, None, "en", "s", 3)], schema)
    assert stage(spark, none, SF).count() == (3 if name in ("jaccard_join", "decontamination", "best_fit_packing") else 0)
    long = "the river runs past the old mill and on to the sea " * 20_000
    odd = spark.createDataFrame([(5, long, "en", "s", len(long)), (5, long, "en", "s", len(long)), (6, "", "en", "s", 0), (7, long[:-9], "en", "s", 1)], schema)
    kept = {r.doc_id for r in stage(spark, odd, SF).collect()}
    assert kept <= {5, 6, 7} and (name in ("language_id", "line_dedup") or 5 in kept)


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_logits_by_parts(monkeypatch):
    """The same sums wherever a part ends, and memory that a long document does not raise."""
    rng = np.random.default_rng(3)
    table = np.vstack([rng.normal(size=(1 << language.BUCKETS, 3)), np.zeros((1, 3))])
    data, off = rng.integers(97, 123, 60).astype(np.uint8), np.array([0, 0, 1, 3, 20, 20, 29, 60, 60])
    whole = np.zeros((8, 3))
    for d, (a, b) in enumerate(zip(off, off[1:], strict=False)):
        found = [table[x] for size in language.GRAMS for x in language.grams(data[a:b], np.array([0, b - a]), size)[0][: max(0, b - a - size + 1)]]
        whole[d] = np.sum(found, axis=0) / len(found) if found else 0
    for part in (1, 2, 3, 7, 59, 60, 1 << 18):
        monkeypatch.setattr(language, "PART", part)
        assert np.allclose(language.logits(data, off, table, np.zeros(3)), whole)
    long = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    assert peak(lambda: language.logits(long, np.array([0, len(long)]), table, np.zeros(3))) < 30e6


def test_training_holds_little():
    """The sample's grams take few bytes: an executor trains beside another worker and what its heap has grown to."""
    rng = random.Random(9)
    made = [["".join(rng.choices(letters, k=5)) for _ in range(5000)] for letters in ("abcdefghij", "klmnopqrst", "uvwxyzabcd")]
    texts = [" ".join(rng.choices(made[k % 3], k=700)) for k in range(900)]
    model = {}
    assert peak(lambda: model.update(language.train(texts, [f"l{k % 3}" for k in range(900)], epochs=1))) < 60e6
    data, off = W.utf8(pa.array([" ".join(x[:300]) for x in made]))
    assert language.logits(data, off, model["table"], model["bias"]).argmax(axis=1).tolist() == [0, 1, 2]


def test_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id bigint, text string")
    model = {"names": [], "table": np.zeros(((1 << language.BUCKETS) + 1, 1)), "bias": np.zeros(1), "temperature": 1.0, "threshold": 0.0}
    items = spark.createDataFrame([("a", "the cat sat")], "item_id string, text string")
    for keep in (["doc_id", "text"], ["text"], ["doc_id"]):
        for out in (language.predict_languages(docs, model, keep=keep), decontaminate.find_contamination(docs, items, keep=keep), decontaminate.find_contamination(docs, items, keep=keep, max_index_words=1)):
            sent = out._jdf.queryExecution().analyzed().toString()
            assert out.columns[: len(keep)] == keep and len(out.collect()) == 2
            assert bool(re.search(r"AS t#\d+", sent)) == ("text" not in keep)


def test_tasks_keep_nothing_for_later():
    """When a task ends, its tokenizer, its words and the tables of powers are freed before memory is handed back."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in W.tidied(packing._tokenise(packing.vocabulary_path(), 4096))(iter([batch]))) == 1
    assert not packing._encoders and not W._tables


def test_words_are_kept_for_the_next_task():
    """A worker's next task of packing takes its encoder, with the words met first; it encodes as a new one does."""
    rng = random.Random(2)
    text = [" ".join(f"w{rng.randrange(9000)}" for _ in range(3000)) for _ in range(2)]
    old, data = packing.Encoder(packing.vocabulary_path()), [W.utf8(pa.array([t])) for t in text]
    old.ids(*data[0])
    old.forget(1000)
    assert len(old.known) == len(old.at) == len(old.size) == 1000 and len(old.flat) == old.size.sum()
    for x in data:
        assert np.array_equal(old.ids(*x)[0], packing.Encoder(packing.vocabulary_path()).ids(*x)[0])
    sent = cloudpickle.loads(cloudpickle.dumps(packing._tokenise(packing.vocabulary_path(), 4096)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(text[:1])], names=["doc_id", "text"])
    list(W.tidied(sent, keeps="encoders")(iter([batch])))
    assert len(packing._encoders[packing.vocabulary_path()].known) > 1000
    W.release()

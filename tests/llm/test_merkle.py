"""The Merkle manifest against a plain version on small tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shuttleplan.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, grp string, pos int, h string, bucket int, levels string, kept string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """(root, proofs as lists of (before, after))."""
    way, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, w in enumerate(way):
            first = w // arity * arity
            proofs[i].append(("".join(nodes[first:w]), "".join(nodes[w + 1 : first + arity])))
        nodes = [sha("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
        way = [w // arity for w in way]
    return nodes[0], proofs


def plain(rows, arity):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r[0]))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])], arity) for k in order}
    root, upper = tree([built[k][0] for k in order], arity)
    out = Counter()
    for k, up in zip(order, upper):
        for (_, _, h, i), proof in zip(sorted(langs[k], key=lambda x: x[:3]), built[k][1]):
            out[i, k, h, built[k][0], root, tuple(proof + up)] += 1
    return out


def table(n=75):
    langs = [None, "", "de", "en", "ß", "zz"]
    rows = [(i * 3 % 71, "s" if i % 4 else None, langs[i % 5] if i % 3 else "en", i if i % 7 else None, "x" * (i % 9) + "é" * (i % 2) if i % 8 else None) for i in range(n)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None), (None, None, "en", 2**63 - 1, "long " * 100_000), (5, "s", "lone", -1, "")]


@pytest.mark.parametrize(("arity", "height"), [(2, 1), (2, 3), (3, 2), (2, 12)])
def test_manifest(spark, arity, height):
    rows = table(30 if height == 1 else 75)
    docs = spark.createDataFrame([(*r, 1, "g", 2, "h", 3, "l", "k") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs, keep=["grp", "bucket"], arity=arity, height=height).withColumn("again", merkle.fold("leaf", "proof")).collect()
    assert all(r.again == r.root and r.grp == "g" and r.bucket == 3 for r in got)
    assert Counter((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in got) == plain(rows, arity)


def test_few_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(7, "s", None, 1, "t")], "doc_id int, source string, lang string, n_chars int, text string")
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == leaf(7, "s", None, 1, "t") and r.proof == []
    with pytest.raises(ValueError, match="leaf"):
        merkle.manifest(one.withColumn("leaf", F.lit(1)), keep=["leaf"])

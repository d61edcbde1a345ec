"""Merkle manifest of a dataset: a root that names its rows, and a proof for every row.

A row's leaf is the hash of its fields. The leaves of a group (its language) stand in id order and are
hashed in runs of ``arity`` until one node is left, the subroot; the subroots, in order of their
groups, give the root in the same way. Texts never move: leaves are hashed where the rows are read.

Leaves are numbered by range partitions and dealt into buckets of ``arity ** height`` places. A bucket is
aligned, so that its nodes meet no others before they are one: a task gets it as an Arrow table and DuckDB
runs one query of ordered ``string_agg`` and ``sha256`` a level. Bucket roots are the leaves of the next tier, until
a group has one node; three tiers hold 10^10 leaves. Proofs come the other way: a bucket's rows meet
the proof of their bucket's root (one row) in a cogroup, so no proof of a leaf is ever shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.operators.order import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, HEIGHT = 2, 12
PROOF = "array<struct<before: string, after: string>>"
OWN = ("doc_id", "lang", "leaf", "subroot", "root", "proof")


def leaf(*fields: str | Column) -> Column:
    """Hash of a row: each field as its length in bytes, a colon and its text, or a dash for null."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and its proof lead to."""
    step = lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256)
    return F.aggregate(proof, F.col(start) if isinstance(start, str) else start, step)


def siblings(proof: str | Column) -> Column:
    """Hash of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


@lru_cache(1)
def _duck():
    """One connection a worker process; buckets are small, so nothing spills."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _build(nodes: pa.Table, levels: int, arity: int):
    """Connection whose table ``node`` has all levels of a bucket, places counted from its first one."""
    con = _duck()
    con.register("bucket", nodes)
    con.execute("create or replace temp table node as select 0 as level, pos - min(pos) over () as pos, h from bucket")
    for level in range(levels):
        con.execute(f"insert into node select {level + 1}, pos // {arity} as up, sha256(string_agg(h, '' order by pos)) from node where level = {level} group by up")
    return con


def _bucket_root(arity: int):
    def root(key: tuple, nodes: pa.Table) -> pa.Table:
        con = _build(nodes, levels := nodes["levels"][0].as_py(), arity)
        top = con.sql(f"select h from node where level = {levels}").to_arrow_table()
        return pa.table({"grp": pa.array([key[0].as_py()] * len(top), pa.string()), "pos": pa.array([key[1].as_py()] * len(top), pa.int64()), "h": top["h"].cast(pa.string())})

    return root


def _bucket_proofs(arity: int):
    def proofs(nodes: pa.Table, above: pa.Table) -> pa.Table:
        levels = nodes["levels"][0].as_py()
        con = _build(nodes, levels, arity)
        con.register("above", above)
        run = f"over (partition by level, pos // {arity} order by pos rows between "
        con.execute(
            f"create or replace temp table sibling as select level, pos, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as before,"
            f" coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as after from node where level < {levels}"
        )
        return con.sql(
            f"""with steps as (select unnest({list(range(levels))}::int[]) as level, unnest({[arity**k for k in range(levels)]}::bigint[]) as width),
            place as (select pos, pos - min(pos) over () as own from bucket), way as (select place.pos, level, own // width as at from place, steps),
            inner_ as (select way.pos, list(struct_pack(before := before, after := after) order by way.level) as proof from way join sibling s on s.level = way.level and s.pos = way.at group by way.pos)
            select bucket.* exclude (levels, bucket), list_concat(coalesce(inner_.proof, []), above.proof) as proof, above.subroot, above.root
            from above, bucket left join inner_ using (pos)"""
        ).to_arrow_table()

    return proofs


def _tier(nodes: DataFrame, sizes: DataFrame, arity: int, height: int) -> DataFrame:
    """Nodes (grp, pos, h, ...) with the bucket that they stand in and the levels to be built there."""
    levels = sum(((F.col("n") > arity**k).cast("int") for k in range(height)), F.lit(0))
    return nodes.join(sizes.select("grp", levels.alias("levels")), "grp").withColumn("bucket", F.expr(f"pos div {arity**height}"))


def _climb(nodes: DataFrame, sizes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Tiers from ``nodes`` up to the one that has a single node a group; ``sizes`` has grp, n."""
    tiers = [_tier(nodes, sizes, arity, height)]
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // arity**height)
        sizes = sizes.select("grp", F.ceil(F.col("n") / F.lit(arity**height)).alias("n"))
        roots = materialize(tiers[-1].groupBy("grp", "bucket").applyInArrow(_bucket_root(arity), "grp string, pos bigint, h string"))
        tiers.append(_tier(roots, sizes, arity, height))
    return tiers


def _prove(tier: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """The rows of a tier with proof, subroot and root; ``above`` has these for (grp, pos) of the bucket roots."""
    keep = [f"{f.name} {f.dataType.simpleString()}" for f in tier.schema if f.name not in ("levels", "bucket")]
    both = tier.groupBy("grp", "bucket").cogroup(above.select("grp", F.col("pos").alias("bucket"), "proof", "subroot", "root").groupBy("grp", "bucket"))
    return both.applyInArrow(_bucket_proofs(arity), f"{', '.join(keep)}, proof {PROOF}, subroot string, root string")


def manifest(docs: DataFrame, keep: list[str] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof) and the columns ``keep``, one row a row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars, text. ``proof`` lists level by level, up to the root, the digests
    that stand before and after the row's own node in its run; both are empty where it stands alone. A null
    language is a group of its own, before all others; null ids come first; a null field hashes as a dash, an empty
    text as length 0. Rows that repeat an id stand in order of their leaf hash; equal rows are all leaves. An empty
    table gives no rows. Other columns are ignored unless kept; those kept may not have the names of the result.
    """
    keep = keep or []
    if clash := {*keep} & {*OWN}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    own = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select("doc_id", "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), leaf(*FIELDS).alias("h"), *own)
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()))
    rows = materialize(numbered(rows, ["grp"], ["doc_id", "h", "tie"], "pos").withColumn("pos", F.col("pos") - 1).drop("tie"))
    tiers = _climb(rows, materialize(rows.groupBy("grp").agg(F.count("*").alias("n"))), arity, height)

    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("member"), "h")
    subroots = materialize(numbered(subroots, ["grp"], ["member"], "pos").withColumn("pos", F.col("pos") - 1))
    top = _climb(subroots, subroots.groupBy("grp").agg(F.count("*").alias("n")), arity, height)
    above = top[-1].select("grp", "pos", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for tier in reversed(top[:-1] if len(top) > 1 else []):
        above = materialize(_prove(tier, above, arity))
    if len(top) == 1:
        above = above.join(subroots.select("pos", "member", "h"), "pos")
    above = above.select(F.col("member").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "proof", F.col("h").alias("subroot"), "root")
    for k, tier in reversed([*enumerate(tiers[:-1])]):
        above = _prove(tier, above, arity)
        above = materialize(above) if k else above
    if len(tiers) == 1:
        above = rows.join(above, ["grp", "pos"])
    return above.select("doc_id", "lang", F.col("h").alias("leaf"), "subroot", "root", "proof", *[F.col(f"kept.{c}").alias(c) for c in keep])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; of every seventh id's hash the row is altered before it is folded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    # decimal, so that the largest number can be raised as well
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    found = manifest(docs.withColumn("altered", leaf("doc_id", "source", "lang", more, "text")), keep=["altered"])
    found = found.withColumns({"proof_sha256": siblings("proof"), "folded_root": fold("altered", "proof")})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = " || ".join("coalesce(strlen({0}) || ':' || {0}, '-')".format(f"cast({c} as varchar)") for c in FIELDS)
OP13_SQL = f"""
with recursive bits as (
  select list(v order by i) as t
  from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(i))
), crcs as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) as crc
  from documents, bits
), d as (
  select doc_id, lang, sha256({_LEAF}) as leaf,
         sha256({_LEAF.replace("cast(n_chars as varchar)", "cast(cast(n_chars as hugeint) + case when crc % 7 = 0 then 1 else 0 end as varchar)")}) as altered
  from crcs
), row as (
  select *, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by lang) as n from d
), low(level, g, p, h, n) as (
  select 0, g, p, leaf, n from row
  union all select level + 1, g, p // 2, sha256(string_agg(h, '' order by p)), (n + 1) // 2 from low where n > 1 group by level, g, p // 2, (n + 1) // 2
), sub as (select g, h, level as depth, row_number() over (order by g) - 1 as p, count(*) over () as n from low where n = 1),
high(level, p, h, n) as (
  select 0, p, h, n from sub
  union all select level + 1, p // 2, sha256(string_agg(h, '' order by p)), (n + 1) // 2 from high where n > 1 group by level, p // 2, (n + 1) // 2
), steps as (
  select row.g, row.p, s.level, coalesce(case when o.p < s.p then 'L' else 'R' end || o.h, '') as x
  from row join low s on s.g = row.g and s.n > 1 and s.p = row.p // (1 << s.level) left join low o on o.g = s.g and o.level = s.level and o.p = xor(s.p, 1)
  union all
  select row.g, row.p, 1000 + s.level, coalesce(case when o.p < s.p then 'L' else 'R' end || o.h, '')
  from row join sub on sub.g = row.g join high s on s.n > 1 and s.p = sub.p // (1 << s.level) left join high o on o.level = s.level and o.p = xor(s.p, 1)
), proof as (select g, p, list(x order by level) as xs from steps group by g, p),
folded as (
  select row.*, coalesce(xs, []) as xs, list_reduce(list_prepend(altered, coalesce(xs, [])), lambda h, x: sha256(case when x[1] = 'L' then x[2:] || h else h || x[2:] end)) as folded_root
  from row left join proof using (g, p)
)
select doc_id, leaf, sub.h as subroot, (select h from high where n = 1) as root, sha256(array_to_string(list_transform(xs, lambda x: x[2:]), '')) as proof_sha256,
       folded_root, folded_root = (select h from high where n = 1) as verified
from folded join sub using (g)
"""

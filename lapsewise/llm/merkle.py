"""A Merkle manifest of a table: a leaf hash for each row, a tree for each group, and a tree over the groups' roots.

H is the lowercase hex SHA-256 of its inputs concatenated. A leaf is H of the row's columns, each "-" if null, else UTF-8
byte count, ":" and value. Within a group leaves ascend by key; FANOUT consecutive nodes (the last run may be shorter)
become their H until one is left, the subroot; subroots ascend by group, null first, and give the root likewise.

Levels are built by a slot pivot: conditional aggregates spread the children of a parent into FANOUT columns; hashing
their concatenation gives the parent, and a child that joins its parent's columns finds its siblings by leaving out its
own slot. So no step holds more than FANOUT nodes of a group together, however large the group. Rows are numbered by
range parts of (group, key): counted in each part, then placed after the parts before it.

Nulls: a null key comes first in its group, a null group is a group. Ties: rows with equal keys are ordered by leaf, so
that equal rows are interchangeable; each has its own place and proof. Empty and very long texts are values like others.
Extra columns are not hashed and change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, read_table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose key has a CRC-32 divisible by this are tampered with by the query.
TAMPER = 5
STEP = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    each = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in each]), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (with group g) plus i, their place in g from 0 by order, and n, the rows of g."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, name)
    per = dealt.groupBy("g", "part").agg(F.count("*").alias("m"))
    group = Window.partitionBy("g")
    before = F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    per = per.select("g", "part", before.alias("before"), F.sum("m").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)).cast("long") - 1
    out = dealt.withColumn("i", inside).join(per, ["g", "part"])
    return out.withColumn("i", F.col("i") + F.col("before")).drop("part", "before")


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """g, i, n, h of the nodes above those that are not alone in their group, and their children's hashes c0, c1, ..."""
    slot, at = F.col("i") % fanout, F.expr(f"i div {fanout}")
    children = [F.max(F.when(slot == k, F.col("h"))).alias(f"c{k}") for k in range(fanout)]
    out = nodes.where("n > 1").groupBy("g", at.alias("p")).agg(F.max("n").alias("below"), *children)
    return out.select("g", F.col("p").alias("i"), F.expr(f"(below + {fanout - 1}) div {fanout}").alias("n"), F.sha2(F.concat(*[F.coalesce(f"c{k}", F.lit("")) for k in range(fanout)]), 256).alias("h"), *[f"c{k}" for k in range(fanout)])


def climb(nodes: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT) -> DataFrame:
    """nodes (g, i, n, h) plus top, the last node of their group, and path: the siblings left and right of each step up to it."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes]
    while most > 1:
        levels.append(scratch.table(parents(levels[-1], fanout), f"{name}-level"))
        most = -(-most // fanout)
    alone = lambda df: df.withColumn("top", F.col("h")).withColumn("path", F.array().cast(STEP))
    above = alone(levels[-1].where("n = 1"))
    for level in levels[-2::-1]:
        children = F.array(*[f"c{k}" for k in range(fanout)])
        columns = above.select("g", F.col("i").alias("p"), children.alias("children"), "top", F.col("path").alias("rest"))
        slot = (F.col("i") % fanout).cast("int")
        side = lambda first, past: F.array_join(F.slice("children", first, past), "")  # noqa: E731  the last run's empty slots are left out
        step = F.struct(side(F.lit(1), slot).alias("left"), side(slot + 2, F.lit(fanout)).alias("right"))
        # children carry columns of their own levels, which the parent's of the same name must not meet
        own = level.where("n > 1").select(F.struct(*level.columns).alias("own"), "g", "i", F.expr(f"i div {fanout}").alias("p"))
        met = own.join(columns, ["g", "p"]).select("own.*", "top", F.concat(F.array(step), "rest").alias("path"))
        above = met.unionByName(alone(level.where("n = 1")))
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, fanout: int = FANOUT, also: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """key, leaf, subroot, root, path of every row, and what also adds to it, worked out beside the leaf in the one pass over the table."""
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    also = also or {}
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then by bytes
    leaves = docs.select(g.alias("g"), F.col(key).alias("key"), leaf(*[F.col(c) for c in columns]).alias("h"), F.monotonically_increasing_id().alias("tie"), *[c.alias(f"also_{x}") for x, c in also.items()])
    leaves = numbered(scratch.table(leaves, "leaves"), ["key", "h", "tie"], scratch, "dealt")
    below = climb(leaves, scratch, "rows", fanout)
    tops = leaves.where("i = 0").select("g").distinct()
    subroots = below.where("i = 0").select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("top").alias("h"))
    subroots = climb(numbered(scratch.table(subroots, "subroots"), ["own"], scratch, "subroots-dealt"), scratch, "groups", fanout)
    groups = subroots.select(F.col("own").alias("g"), F.col("top").alias("root"), F.col("path").alias("above"))
    out = below.join(scratch.table(groups, "groups"), "g")
    return out.select(F.col("key").alias(key), F.col("h").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "above").alias("path"), *[F.col(f"also_{x}").alias(x) for x in also])


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    tampered = F.when(hit, leaf(*[lowered.get(c, F.col(c)) for c in COLUMNS]))
    out = manifest(read_table(spark, sf_dir, "documents"), also={"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL spells out: enough for 16 ** 6 rows of a source, and sources.
SQL_LEVELS = 6


def tree_sql(name: str) -> str:
    """CTEs name0 (g, i, n, h) to the top: siblings (name_s: g, k, i, l, r) and last nodes (name_t: g, top)."""
    out, both = "", " UNION ALL ".join(f"SELECT g, {k} AS k, i, l, r FROM {name}w{k}" for k in range(SQL_LEVELS))
    for k in range(SQL_LEVELS):
        run = f"PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        out += f", {name}w{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"
        out += f", {name}{k + 1} AS (SELECT g, i // {FANOUT} AS i, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}w{k} GROUP BY g, i // {FANOUT})"
    tops = " UNION ALL ".join(f"SELECT g, h AS top FROM {name}{k} WHERE n = 1" for k in range(SQL_LEVELS + 1))
    return out + f", {name}_s AS ({both}), {name}_t AS ({tops})"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (text if c == "text" else c for c in COLUMNS)) + ")"


#: Siblings of a row at every level: its own tree's, then its source's.
STEPS = " UNION ALL ".join([f"SELECT p.r0, {k} AS k, s.l, s.r FROM placed p JOIN a_s s ON s.k = {k} AND s.g = p.g AND s.i = p.i // {FANOUT**k}" for k in range(SQL_LEVELS)] + [f"SELECT p.r0, {SQL_LEVELS + k}, s.l, s.r FROM placed p JOIN b0 ON b0.own = p.g JOIN b_s s ON s.k = {k} AND s.i = b0.i // {FANOUT**k}" for k in range(SQL_LEVELS)])
LOWER_SQL = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::BIGINT]))"
SQL = f"""
WITH RECURSIVE bits AS (SELECT b, b::UBIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
leaves AS (SELECT row_number() OVER () AS r0, doc_id, coalesce('1' || source, '0') AS g, {leaf_sql("text")} AS h, CASE WHEN xor({CRC}, 4294967295::UBIGINT) % {TAMPER} = 0 THEN {leaf_sql(LOWER_SQL)} END AS tampered FROM documents CROSS JOIN crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, r0) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS (SELECT g, i, n, h FROM placed){tree_sql("a")},
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, top AS h, g AS own FROM a_t){tree_sql("b")},
steps AS ({STEPS}),
paths AS (SELECT r0, string_agg(l || r, '' ORDER BY k) AS proof, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs FROM steps GROUP BY r0),
walk AS (SELECT p.r0, coalesce(tampered, h) AS h, 1 AS k, ls, rs FROM placed p LEFT JOIN paths ON paths.r0 = p.r0 UNION ALL SELECT r0, sha256(ls[k] || h || rs[k]), k + 1, ls, rs FROM walk WHERE k <= len(ls)),
folded AS (SELECT r0, arg_max(h, k) AS folded_root FROM walk GROUP BY r0)
SELECT doc_id, h AS leaf, a_t.top AS subroot, b_t.top AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = b_t.top AS verified
FROM placed p JOIN a_t ON a_t.g = p.g CROSS JOIN b_t JOIN folded f ON f.r0 = p.r0 LEFT JOIN paths ON paths.r0 = p.r0
"""

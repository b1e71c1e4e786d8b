"""Merkle manifest of a table of documents, and proofs by a recursive climb.

A document is a leaf, the leaves of a language in order of doc_id are a tree, and the roots of these trees are the leaves of one top tree. On
each level every two consecutive nodes become one; a last node without a partner is hashed alone.

Building. A leaf's position in its tree follows from a range partitioning and the row counts of the partitions before. Blocks of
`FAN` = 256 consecutive nodes, eight levels, are hashed in one task each, then the blocks of the blocks' roots, so a tree of n leaves takes
log256(n) shuffles of ever fewer rows. A stored row, of a leaf or of a node at every eighth level, has the siblings on the levels up to the
next such node, which is its parent row; the rows at the end of a language's tree go on with the siblings of the top tree, and have no parent.

Climbing. `WITH RECURSIVE` starts with every leaf row, tampered where a change is given. A step appends the row's siblings, folds the hash
over them and joins the parent row for the next ones, until there is no parent. Every leaf climbs by itself; hashes travel as 32 bytes.

Results in special cases: a null value is hashed as `-`, so it differs from an empty text; a null language is a tree of its own and the
first; leaves of one doc_id are ordered by hash, a missing doc_id is the first; repeated rows are leaves each; a tree of one leaf is that
leaf, and a proof without siblings is the hash of nothing; an empty table gives no rows; a text of any length is hashed in the row, and only
hashes move. Only the five columns of a leaf are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradewise.llm.common import stored
from gradewise.operators.sizes import is_small, sent_if

LEVELS = 8
FAN = 1 << LEVELS
#: Node rows above the leaves, of about 400 bytes, that are sent to all tasks; more are joined by shuffle.
SENT_ROWS = 20_000
#: Key of the top tree; language trees have the keys "" (null) and "=" with the language.
TOP = "!"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

def digest(values: list[Column]) -> Column:
    """Sha256, as 32 bytes, of the values, each `-` if null, else its number of UTF-8 bytes, a colon, and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, changed: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, leaf, tampered): one row per document; `tampered` is the leaf after `changes`, where `changed` holds, else null."""
    now = [docs[c] for c in FIELDS]
    then = [(changes or {}).get(c, docs[c]) for c in FIELDS]
    tampered = F.lit(None).cast("binary") if changed is None else F.when(changed, digest(then))
    tree = F.when(docs["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["lang"].cast("string")))
    return docs.select(docs["doc_id"].alias("doc_id"), tree.alias("tree"), digest(now).alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with `pos`, the place from 0 within `tree` by `order`, and `size`, the rows of the tree. No window over rows: partitions are counted."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["tree", *order]
    # the id's lower 33 bits count the rows of a partition, its upper bits are the partition, in order of the ranges
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_at", 33)), name)
    counts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("tree").orderBy("_part")  # a row for each partition that the tree has rows in
    starts = counts.select(
        "tree",
        "_part",
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_start"),
        F.sum("_n").over(W.partitionBy("tree")).alias("size"),
    )
    joined = dealt.join(stored(starts, name + "-starts"), ["tree", "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def merged(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above `nodes`: until one is left if they are a `whole` tree, else as many as a block has."""
    levels = [nodes]
    while len(nodes) > 1 if whole else len(levels) <= LEVELS:
        nodes = [hashlib.sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[bytes | None], int]:
    """Partners of node `at` on each level below the last, null where it has none, and a bit for each that stands on the right."""
    path, right = [], 0
    for up, level in enumerate(levels[:-1]):
        other = (at >> up) ^ 1
        path.append(bytes.fromhex(level[other]) if other < len(level) else None)
        right |= (other & 1) << up
    return path, right


def _linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = {f.name: f.type for f in batch.schema.field("nodes").type.value_type}
        for block in batch.to_pylist():
            nodes, last = block["nodes"], block["size"] <= FAN
            levels = merged([x["hash"].hex() for x in nodes], last)
            paths = [siblings(levels, i) for i in range(len(nodes))]
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block["tree"]] * n, pa.string()),
                    *[pa.array([x[c] for x in nodes], kinds[c]) for c in ("pos", "hash", "doc_id", "tampered")],
                    pa.array([p for p, _ in paths], pa.list_(pa.binary())),
                    pa.array([r for _, r in paths], pa.int64()),
                    pa.array([last] * n, pa.bool_()),
                    pa.array([bytes.fromhex(levels[-1][0])] + [None] * (n - 1), pa.binary()),
                ],
                names=["tree", "pos", "hash", "doc_id", "tampered", "path", "right", "last", "root"],
            )


def linked(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rows of every eighth level of the trees whose leaves are (tree, pos, size, hash, doc_id, tampered), lowest first, and (tree, root).

    All are stored tables; `last` marks rows whose siblings reach to the root of the tree.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()
    rows = f"tree string, pos long, hash binary, doc_id {kind}, tampered binary, path array<binary>, right long, last boolean, root binary"
    stages, roots = [], []
    while True:
        # at most FAN entries of a few hashes meet in a row
        entries = F.array_sort(F.collect_list(F.struct("pos", "hash", "doc_id", "tampered")))
        blocks = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("block"), "size").agg(entries.alias("nodes"))
        built = stored(blocks.mapInArrow(_linked_rows, rows), f"{name}-{len(stages)}")
        stages.append(built)
        roots.append(built.where("last AND root IS NOT NULL").select("tree", "root"))
        above = built.where("NOT last AND root IS NOT NULL").select(
            "tree", F.floor(F.col("pos") / FAN).alias("pos"), F.col("root").alias("hash"), F.lit(None).cast(kind).alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        if above.isEmpty():
            return stages, stored(reduce(DataFrame.unionAll, roots), f"{name}-roots")
        nodes = above.join(above.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "tree")


class Manifest:
    """Stored tables of a built manifest: linked leaf rows, linked node rows above them, and one root per tree; and the root of all."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, subroots: DataFrame, root: bytes | None):
        self.leaves, self.nodes, self.subroots, self.root = leaves, nodes, subroots, root


def manifest(rows: DataFrame) -> Manifest:
    """Build the trees over `leaves(...)` and link them."""
    own = placed(rows, ["doc_id", "leaf"], "leaves").withColumnRenamed("leaf", "hash")
    inner, subroots = linked(own, "trees")
    none = F.lit(None)
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("doc_id"), F.col("root").alias("hash"), none.cast("binary").alias("tampered"))
    outer, roots = linked(placed(named, ["doc_id"], "top"), "top")
    first = roots.first()
    # the stages of the top tree as one path for each language: as long as the logarithm of their number
    ends = outer[0].select(F.col("doc_id").alias("tree"), F.floor(F.col("pos") / FAN).alias("_at"), F.col("path").alias("rest"), F.col("right").alias("beyond"))
    for stage in outer[1:]:
        step = stage.select(F.col("pos").alias("_at"), "path", "right")
        ends = ends.join(step, "_at").select(
            "tree",
            F.floor(F.col("_at") / FAN).alias("_at"),
            F.concat("rest", "path").alias("rest"),
            F.col("beyond").bitwiseOR(F.call_function("shiftleft", F.col("right"), F.size("rest"))).alias("beyond"),
        )
    ends = stored(ends.select("tree", "rest", "beyond"), "top-paths")

    def with_ends(stage: DataFrame) -> DataFrame:
        stage = stage.drop("root")
        done = stage.where("last").join(ends, "tree").select(
            *[c for c in stage.columns if c not in ("path", "right")],
            F.concat("path", "rest").alias("path"),
            F.col("right").bitwiseOR(F.call_function("shiftleft", F.col("beyond"), F.size("path"))).alias("right"),
        )
        return stage.where("NOT last").unionByName(done)

    parents = [with_ends(s).select(F.lit(i).alias("stage"), "tree", "pos", "path", "right", "last") for i, s in enumerate(inner) if i]
    nothing = inner[0].limit(0).select(F.lit(0).alias("stage"), "tree", "pos", "path", "right", "last")
    return Manifest(with_ends(inner[0]), stored(reduce(DataFrame.unionAll, parents, nothing), "nodes"), subroots, first["root"] if first else None)


CLIMB_SQL = f"""
WITH RECURSIVE climb (doc_id, tree, leaf, folded, proof, path, right, stage, pos) AS (
    SELECT doc_id, tree, hash, coalesce(tampered, hash), CAST('' AS BINARY), path, right, CASE WHEN NOT last THEN 1 END, pos DIV {FAN} FROM {{leaves}}
    UNION ALL
    SELECT c.doc_id, c.tree, c.leaf,
        aggregate(c.path, named_struct('h', c.folded, 'i', 0), (a, s) -> named_struct('h', unhex(sha2(CASE
            WHEN s IS NULL THEN lower(hex(a.h))
            WHEN getbit(c.right, a.i) = 1 THEN concat(lower(hex(a.h)), lower(hex(s)))
            ELSE concat(lower(hex(s)), lower(hex(a.h))) END, 256)), 'i', a.i + 1)).h,
        aggregate(c.path, c.proof, (a, s) -> concat(a, coalesce(s, CAST('' AS BINARY)))),
        n.path, n.right, CASE WHEN NOT n.last THEN n.stage + 1 END, c.pos DIV {FAN}
    FROM climb c LEFT JOIN {{nodes}} n ON c.tree = n.tree AND c.stage = n.stage AND c.pos = n.pos
    WHERE c.path IS NOT NULL
)
SELECT doc_id, tree, leaf, folded, sha2(lower(hex(proof)), 256) AS proof_sha256 FROM climb WHERE path IS NULL
"""

#: The climb makes a row for each leaf and stage; Spark's default stops a recursion at a million rows.
_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(spark: SparkSession, built: Manifest) -> DataFrame:
    """(doc_id, tree, leaf, folded, proof_sha256) of every leaf, by a recursive query. A stored table, as the limit on rows is lifted only here."""
    nodes = sent_if(built.nodes, is_small(built.nodes, SENT_ROWS))
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, "-1")
    try:
        return stored(spark.sql(CLIMB_SQL, leaves=built.leaves, nodes=nodes), "climbed")
    finally:
        spark.conf.set(_LIMIT, before)


def proofs(docs: DataFrame, changed: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): does each leaf, changed where `changed` holds, fold to the root?"""
    built = manifest(leaves(docs, changed, changes))
    rows = climbed(docs.sparkSession, built).join(built.subroots.withColumnRenamed("root", "subroot"), "tree")
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(built.root).cast("binary")
    return rows.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text(root).alias("root"),
        "proof_sha256",
        text("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def tamper_report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, where those with a crc32 of the decimal doc_id that 7 divides have one more in n_chars."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return proofs(docs, hit, {"n_chars": docs["n_chars"] + 1})


def _levels_sql(name: str, source: str) -> str:
    """All levels of the trees of `source` (tree, pos, n, h)."""
    return f"""{name} (tree, level, pos, n, h) AS (
    SELECT tree, 0, pos, n, h FROM {source}
    UNION ALL
    SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(other, ''))
    FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY pos) AS other FROM {name}) WHERE pos % 2 = 0 AND n > 1
)"""


def _steps_sql(source: str, levels: str, tree: str, pos: str, plus: int) -> str:
    """A row for each leaf and level below the root: side and hash of the sibling."""
    return f"""SELECT t.tree, t.pos, {plus} + v.level AS step,
        CASE WHEN o.h IS NULL THEN 'N' WHEN o.pos > v.pos THEN 'R' || o.h ELSE 'L' || o.h END AS s
    FROM {source} t JOIN {levels} v ON v.tree = t.{tree} AND v.n > 1 AND v.pos = t.{pos} >> v.level
    LEFT JOIN {levels} o ON o.tree = v.tree AND o.level = v.level AND o.pos = xor(v.pos, 1)"""


def _leaf_sql(n_chars: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE bits AS (
    SELECT *, list_reduce([4294967295] || flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: list_transform(range(0, 8), lambda j: (ascii(CAST(doc_id AS VARCHAR)[i]) >> j) & 1))),
        lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM documents
), d AS (
    SELECT doc_id, lang, {_leaf_sql("n_chars")} AS h,
        CASE WHEN xor(c, 4294967295) % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS tampered FROM bits
), leaf AS (
    SELECT CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, doc_id, h, tampered,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), {_levels_sql("inner_levels", "leaf")}, sub AS (
    SELECT '' AS tree, tree AS below, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM inner_levels WHERE n = 1
), {_levels_sql("outer_levels", "sub")}, under AS (
    SELECT leaf.tree, leaf.pos, sub.tree AS above, sub.pos AS place FROM leaf JOIN sub ON sub.below = leaf.tree
), steps AS (
    {_steps_sql("leaf", "inner_levels", "tree", "pos", 0)}
    UNION ALL
    {_steps_sql("under", "outer_levels", "above", "place", 64)}
), paths AS (
    SELECT tree, pos, list(s ORDER BY step) AS path, string_agg(substr(s, 2), '' ORDER BY step) AS siblings FROM steps GROUP BY ALL
), folded AS (
    SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce([coalesce(tampered, leaf.h)] || coalesce(path, []), lambda a, s: sha256(CASE s[1]
            WHEN 'L' THEN substr(s, 2) || a WHEN 'R' THEN a || substr(s, 2) ELSE a END)) AS folded_root
    FROM leaf JOIN sub ON sub.below = leaf.tree LEFT JOIN paths ON paths.tree = leaf.tree AND paths.pos = leaf.pos
    JOIN (SELECT h FROM outer_levels WHERE n = 1) top ON true
)
SELECT *, folded_root = root AS verified FROM folded
"""

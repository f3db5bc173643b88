"""Merkle manifest of a dataset: leaves by row, a tree per group, a tree over the groups.

Nodes of a level are combined two by two. A chunk of ``CHUNK`` consecutive nodes
is climbed in one sorted window: at level ``j`` the first row of a node finds
its sibling ``2 ** j`` rows ahead (slot 0) or behind (slot 1), masked by slot and
by the length of the run; first-child rows hash the parent. So one shuffle serves
``STEP`` levels, whatever the size of a group, and the tops of the chunks are the
nodes of the next climb. A row's proof is put together downwards: its own chunk's
siblings, then those of the chunk above.

Positions come from a range partition of the leaves, counted per partition, so
that no task sees a whole group; equal rows are spread by their place in the input.

Defined results: a null in any column is hashed as ``-`` (an empty text as
``0:``); null groups come first and form a group of their own; within a group,
null ids come first and repeated ids follow their leaf; repeated rows are leaves
of their own; a group of one row has that leaf as its subroot, and a single group
its subroot as root; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import shared_folder, stored

#: Levels that one sorted window climbs, and the nodes of a chunk.
STEP = 10
CHUNK = 1 << STEP
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """Hash of values, each preceded by its length in bytes."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def numbered(leaves: DataFrame, order: Sequence[str], folder: str) -> DataFrame:
    """Add the place of a row in its tree (``pos``, from 0) and the tree's rows (``n``)."""
    keys = ["tree", *order, "scan"]
    scanned = leaves.withColumn("scan", F.monotonically_increasing_id())
    ranged = stored(
        scanned.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).drop("scan"),
        folder, "ranged",
    )
    # A row per tree and partition: in all at most trees plus partitions.
    counts = ranged.groupBy("tree", "part").agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    starts = counts.select(
        "tree", "part",
        (F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    return ranged.join(stored(starts, folder, "starts"), ["tree", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def climb(nodes: DataFrame, step: int = STEP) -> DataFrame:
    """Add ``path``, the siblings of a row's ancestors in its chunk, and ``top``, the chunk's node on its first row.

    ``nodes`` has tree, pos, n, digest. A path entry is the side of the sibling (L
    or R) and its digest, which is missing where a run has one node.
    """
    size = 1 << step
    rows = nodes.withColumn("chunk", F.floor(F.col("pos") / size)).withColumn("at", F.col("pos") % size).withColumn("top", F.col("digest"))
    window = Window.partitionBy("tree", "chunk").orderBy("at")
    for level in range(step):
        width = 1 << level
        rows = rows.withColumns({"before": F.lag("top", width).over(window), "after": F.lead("top", width).over(window)})
        first, second_slot, several = F.col("at") % width == 0, F.floor(F.col("at") / width) % 2 == 1, F.col("n") > width
        beside = F.when(second_slot, F.concat(F.lit("L"), "before")).otherwise(F.concat(F.lit("R"), F.coalesce("after", F.lit(""))))
        parent = F.sha2(F.concat("top", F.coalesce("after", F.lit(""))).cast("binary"), 256)
        rows = rows.withColumns({
            f"side{level}": F.when(first & several, beside),
            "top": F.when(first & ~second_slot, F.when(several, parent).otherwise(F.col("top"))),
        })
    sofar = window.rowsBetween(Window.unboundedPreceding, 0)
    # The first row of a node holds its sibling; the rows behind it take it from there.
    sides = rows.withColumns({f"side{j}": F.last(f"side{j}", ignorenulls=True).over(sofar) for j in range(step)})
    path = F.filter(F.array(*[f"side{j}" for j in range(step)]), lambda s: s.isNotNull())
    return sides.withColumn("path", path).drop("before", "after", *[f"side{j}" for j in range(step)])


def grow(leaves: DataFrame, folder: str, name: str, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """Climb until every tree has one node.

    Returns the leaves with ``path`` up to their tree's top, and (tree, digest) of the tops.
    """
    size, levels, nodes = 1 << step, [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        levels.append(stored(climb(nodes, step), folder, f"{name}-{len(levels)}"))
        tops = levels[-1].filter("at = 0").select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("digest"))
        most = -(-most // size)
        if most <= 1:
            break
        nodes = tops
    above = None
    for level in reversed(levels):
        if above is not None:
            level = level.join(above, ["tree", "chunk"]).withColumn("path", F.concat("path", "more")).drop("more")
        above = level.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("more"))
    return level.drop("chunk", "at", "top"), tops.select("tree", "digest")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def up(node: Column, entry: Column) -> Column:
        other = F.substring(entry, 2, 64)
        return F.sha2(F.when(entry.startswith("L"), F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def build(leaves: DataFrame, order: Sequence[str], folder: str, step: int = STEP) -> DataFrame:
    """Trees over rows with ``tree`` (not null) and ``digest``; adds path, subroot and root.

    Trees follow each other by their name's bytes.
    """
    own, subroots = grow(numbered(leaves, order, f"{folder}/rows"), folder, "rows", step)
    subroots = stored(subroots, folder, "subroots")
    upper = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], f"{folder}/groups")
    paths, root = grow(upper, folder, "groups", step)
    known = root.first()
    ends = paths.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("more"))
    return (
        own.join(ends, "tree").withColumn("path", F.concat("path", "more")).drop("more")
        .withColumn("root", F.lit(known.digest if known else None).cast("string"))
    )


def manifest(
    docs: DataFrame, columns: Sequence[str] = LEAF_COLUMNS, group: str = "lang", key: str = "doc_id",
    folder: str | None = None, step: int = STEP,
) -> DataFrame:
    """One row per row of ``docs``: its key, leaf, subroot, root and path (side and digest of each sibling, leaf to root)."""
    folder = folder or shared_folder(docs.sparkSession)
    return build(_leaves(docs, columns, group, key, [], folder), ["id", "digest"], folder, step).select(
        F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path"
    )


def _leaves(docs: DataFrame, columns: Sequence[str], group: str, key: str, extra: Sequence[Column], folder: str) -> DataFrame:
    # The empty name is the null group's; all others follow it.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return stored(docs.select(tree.alias("tree"), F.col(key).alias("id"), leaf_hash(*map(F.col, columns)).alias("digest"), *extra), folder, "leaves")


def checked(docs: DataFrame, folder: str | None = None, step: int = STEP) -> DataFrame:
    """The manifest of documents, and the root recomputed for every row after a change to some of them.

    Rows whose unsigned crc32 of doc_id is divisible by 7 count as changed: one is added to their n_chars.
    """
    folder = folder or shared_folder(docs.sparkSession)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])
    leaves = _leaves(docs, LEAF_COLUMNS, "lang", "doc_id", [F.when(hit, other).alias("tampered")], folder)
    rows = build(leaves, ["id", "digest"], folder, step)
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    return rows.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BITS = "[1, 2, 3, 4, 5, 6, 7, 8]"
OP11_SQL = f"""
WITH RECURSIVE given AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS name, row_number() OVER (ORDER BY doc_id) AS line FROM documents
), crc(line, name, spot, code) AS (
  SELECT line, name, 1, CAST(4294967295 AS BIGINT) FROM given
  UNION ALL
  SELECT line, name, spot + 1,
         list_reduce(list_prepend(xor(code, CAST(ascii(substr(name, spot, 1)) AS BIGINT)), {_BITS}),
                     lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
  FROM crc WHERE spot <= length(name)
), marked AS (
  SELECT g.*, xor(c.code, 4294967295) % 7 = 0 AS hit
  FROM given g JOIN crc c ON c.line = g.line AND c.spot = length(g.name) + 1
), encoded AS (
  SELECT doc_id, lang, hit,
         coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS size,
         coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS other_size,
         coalesce(strlen(text) || ':' || text, '-') AS body
  FROM marked
), leaves AS (
  SELECT doc_id, lang, sha256(head || size || body) AS leaf,
         sha256(head || CASE WHEN hit THEN other_size ELSE size END || body) AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM encoded
), nodes(level, lang, pos, digest) AS (
  SELECT 0, lang, pos, leaf FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(digest || coalesce(after, ''))
  FROM (SELECT level, lang, pos, digest, lead(digest) OVER (PARTITION BY lang ORDER BY pos) AS after,
               count(*) OVER (PARTITION BY lang) AS n FROM nodes)
  WHERE n > 1 AND pos % 2 = 0
), subroots AS (
  SELECT lang, digest, level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY level DESC) AS place FROM nodes) WHERE place = 1
), upper(level, pos, digest) AS (
  SELECT 0, pos, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(digest || coalesce(after, ''))
  FROM (SELECT level, pos, digest, lead(digest) OVER (ORDER BY pos) AS after, count(*) OVER () AS n FROM upper)
  WHERE n > 1 AND pos % 2 = 0
), top AS (SELECT digest AS root, level AS height FROM upper ORDER BY level DESC LIMIT 1),
folds(doc_id, lang, leaf, pos, level, node, siblings) AS (
  SELECT doc_id, lang, leaf, pos, 0, start, '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.pos // 2, f.level + 1,
         sha256(CASE WHEN f.pos % 2 = 1 THEN o.digest || f.node ELSE f.node || coalesce(o.digest, '') END),
         f.siblings || coalesce(o.digest, '')
  FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.pos = xor(f.pos, 1)
  WHERE f.level < s.level
), folded AS (
  SELECT f.doc_id, f.leaf, s.digest AS subroot, s.pos, f.node, f.siblings
  FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level
), climbs(doc_id, leaf, subroot, pos, level, node, siblings) AS (
  SELECT doc_id, leaf, subroot, pos, 0, node, siblings FROM folded
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.pos // 2, c.level + 1,
         sha256(CASE WHEN c.pos % 2 = 1 THEN o.digest || c.node ELSE c.node || coalesce(o.digest, '') END),
         c.siblings || coalesce(o.digest, '')
  FROM climbs c CROSS JOIN top LEFT JOIN upper o ON o.level = c.level AND o.pos = xor(c.pos, 1)
  WHERE c.level < height
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climbs CROSS JOIN top WHERE level = height
"""

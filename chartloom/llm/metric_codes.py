"""Vector codes by parts: a codebook per part, found over anchors-hierarchy metric trees.

Vectors become integers and are cut into equal parts; a code names the nearest
entry of each part's codebook. Vectors are taken in blocks of ``BLOCK`` rows, and
for every part of a block a metric tree is built middle-out: about the square
root of n anchors each take the points nearer to them than to any other anchor,
farthest point first; anchors are then joined upwards, two balls of the smallest
common radius at a time, and each anchor's points are treated alike downwards.
Balls cache the sums and the count of their points. The trees are written once
and read in every round.

A round sends every tree down level by level with a list of candidate entries a
ball, inherited from its parent. Entry ``b`` drops out of a ball with centre c and
radius r when some entry ``a`` is nearer to all its points, that is when
``|c-b|^2 - |c-a|^2 > 2 r |a-b|``. A ball with one candidate left is owned: its
cached sums go to that entry and nothing below it is looked at. Points of leaves
that stay open are compared with the candidates left. Only sums and counts by
part and entry leave the tasks; the driver holds the codebooks, whose size is fixed.

Defined results: rows whose vector is null, empty or holds null or non-finite
components are dropped; null ids come last and repeated ids follow their vector
when the first entries are chosen; with fewer rows than entries a codebook is
shorter; repeated rows are coded alike; an empty table gives no row; further
columns are ignored. Vectors of unequal length, a length that the parts do not
divide, and components beyond ``LIMIT`` as integers stop the job with an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import importable, shared_folder, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that share a tree, and the points of a ball that is not divided further.
BLOCK, LEAF = 2048, 16
#: Largest size of an integer component: squared distances of a part then fit in 64 bits.
LIMIT = 1 << 27


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as integers, rounded down."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if (np.abs(scaled) > LIMIT).any():
        raise ValueError(f"a component is beyond {LIMIT} as an integer")
    return scaled.astype(np.int64)


class Tree:
    """Balls in breadth-first order over points in the order of ``order``.

    A ball covers ``order[start:stop]``; ``level`` holds where each level begins.
    """

    FIELDS = ("order", "start", "stop", "parent", "leaf", "level", "centre", "radius", "total")

    def __init__(self, **fields: np.ndarray) -> None:
        self.__dict__.update(fields)


def anchors(points: np.ndarray, wanted: int) -> tuple[np.ndarray, list[int]]:
    """Owner of every point among at most ``wanted`` anchors, and the anchors' points."""
    owner, chosen = np.zeros(len(points), np.int64), [0]
    far = ((points - points[0]) ** 2).sum(1).astype(np.float64)
    while len(chosen) < wanted:
        # The farthest point of the widest anchor becomes the next one.
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = ((points[chosen] - points[new]) ** 2).sum(1)
        # A point nearer to its anchor than half the way to the new one stays.
        open_to = np.flatnonzero(4 * far > between[owner])
        own = ((points[open_to] - points[new]) ** 2).sum(1)
        won = own < far[open_to]
        owner[open_to[won]], far[open_to[won]] = len(chosen), own[won]
        chosen.append(new)
    return owner, chosen


def _ball(points: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, float]:
    own = points[members]
    centre = own.mean(0)
    return centre, float(np.sqrt(((own - centre) ** 2).sum(1).max()))


def _middle_out(points: np.ndarray, members: np.ndarray) -> tuple:
    """A nested ball: (members, children)."""
    own = points[members]
    if len(members) <= LEAF or (own == own[0]).all():
        return members, ()
    owner, chosen = anchors(own, max(2, round(len(members) ** 0.5)))
    groups = [members[owner == k] for k in range(len(chosen))]
    nodes = [_middle_out(points, g) for g in groups if len(g)]
    balls = [_ball(points, n[0]) for n in nodes]
    centre, radius = np.array([b[0] for b in balls]), np.array([b[1] for b in balls])
    # Bound of the radius of two balls together; the closest two are joined first.
    span = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
    np.fill_diagonal(span, np.inf)
    left = len(nodes)
    while left > 1:
        i, j = divmod(int(span.argmin()), len(nodes))
        nodes[i] = (np.concatenate([nodes[i][0], nodes[j][0]]), (nodes[i], nodes[j]))
        span[j], span[:, j] = np.inf, np.inf
        centre[i], radius[i] = _ball(points, nodes[i][0])
        row = np.sqrt(((centre - centre[i]) ** 2).sum(1)) + radius + radius[i]
        row[~np.isfinite(span[i])] = np.inf
        span[i], span[:, i] = row, row
        span[i, i] = np.inf
        left -= 1
        top = i
    return nodes[top] if len(nodes) > 1 else nodes[0]


def grow(points: np.ndarray) -> Tree:
    """Metric tree of the integer points of one part."""
    level, start, stop, parent, leaf, sizes = [(_middle_out(points, np.arange(len(points))), 0, -1)], [], [], [], [], [0]
    order = np.zeros(len(points), np.int64)
    while level:
        below = []
        for (members, children), at, above in level:
            me = len(start)
            start.append(at)
            stop.append(at + len(members))
            parent.append(above)
            leaf.append(not children)
            if not children:
                order[at : at + len(members)] = members
            for child in children:
                below.append((child, at, me))
                at += len(child[0])
        sizes.append(len(start))
        level = below
    start, stop = np.array(start), np.array(stop)
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], 0)])
    total = sums[stop] - sums[start]
    centre = total / (stop - start)[:, None]
    spread = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(start, stop, centre, strict=True)])
    return Tree(
        order=order, start=start, stop=stop, parent=np.array(parent), leaf=np.array(leaf), level=np.array(sizes),
        centre=centre, radius=spread, total=total,
    )


def descend(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Owned balls as (ball, entry), and points compared one by one as (point, entry).

    Together they cover every point once. Equal distances go to the lower entry.
    """
    k = len(entries)
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2).astype(np.float64))
    lists = np.ones((len(tree.start), k), bool)
    done = np.zeros(len(tree.start), bool)
    owned_ball, owned_entry, open_point, open_entry = [], [], [], []
    for low, high in zip(tree.level[:-1], tree.level[1:], strict=True):
        balls = np.arange(low, high)
        if low:
            up = tree.parent[balls]
            done[balls], lists[balls] = done[up], lists[up]
        balls = balls[~done[balls]]
        if not len(balls):
            continue
        far = ((tree.centre[balls][:, None] - entries[None]) ** 2).sum(2)
        held = lists[balls]
        best = np.where(held, far, np.inf).argmin(1)
        lead = far - far[np.arange(len(balls)), best][:, None]
        # The margin keeps rounding from dropping an entry that is as near as the best one.
        reach = 2 * tree.radius[balls][:, None] * apart[best]
        held &= lead <= reach * (1 + 1e-9) + 1e-9 * (far + 1)
        held[np.arange(len(balls)), best] = True
        lists[balls] = held
        sole = held.sum(1) == 1
        owned_ball.append(balls[sole])
        owned_entry.append(best[sole])
        done[balls[sole]] = True
        rest = balls[~sole & tree.leaf[balls]]
        if len(rest):
            count = tree.stop[rest] - tree.start[rest]
            spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(tree.start[rest], count)
            which = tree.order[spot]
            near = ((points[which][:, None] - entries[None]) ** 2).sum(2)
            near[~np.repeat(lists[rest], count, axis=0)] = np.iinfo(np.int64).max
            open_point.append(which)
            open_entry.append(near.argmin(1))
            done[rest] = True
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return (flat(owned_ball), flat(owned_entry)), (flat(open_point), flat(open_entry))


def gathered(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points by their nearest entry."""
    (ball, of), (point, to) = descend(tree, points, entries)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    np.add.at(sums, of, tree.total[ball])
    np.add.at(counts, of, tree.stop[ball] - tree.start[ball])
    np.add.at(sums, to, points[point])
    np.add.at(counts, to, 1)
    return sums, counts


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entry of every point."""
    (ball, of), (point, to) = descend(tree, points, entries)
    out = np.zeros(len(points), np.int64)
    for b, e in zip(ball.tolist(), of.tolist(), strict=True):
        out[tree.order[tree.start[b] : tree.stop[b]]] = e
    out[point] = to
    return out


def pack(points: np.ndarray, trees: list[Tree]) -> bytes:
    made = io.BytesIO()
    narrow = lambda v: v.astype(np.int32) if v.dtype == np.int64 and not (np.abs(v) >> 31).any() else v
    np.savez(made, points=narrow(points), **{f"{f}{p}": narrow(getattr(t, f)) for p, t in enumerate(trees) for f in Tree.FIELDS})
    return made.getvalue()


def unpack(data: bytes, parts: int) -> tuple[np.ndarray, list[Tree]]:
    wide = lambda v: v.astype(np.int64) if v.dtype == np.int32 else v
    with np.load(io.BytesIO(data)) as kept:
        return wide(kept["points"]), [Tree(**{f: wide(kept[f"{f}{p}"]) for f in Tree.FIELDS}) for p in range(parts)]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that are kept, with the vector as doubles."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", whole.alias("embedding")).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def first_entries(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, position) of the smallest ids. At most ``entries`` rows reach the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if len({len(r.embedding) for r in rows}) > 1 or any(len(r.embedding) % parts for r in rows):
        raise ValueError(f"vectors must have one length that {parts} parts divide")
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    whole = integers(np.array([r.embedding for r in rows]), scale)
    return whole.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def blocks(kept: DataFrame, width: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Rows of at most BLOCK vectors with their ids, labels and packed trees."""
    importable(kept.sparkSession)
    length = width * parts
    label = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                lists = own.column("embedding")
                if (np.diff(lists.offsets.to_numpy()) != length).any():
                    raise ValueError("vectors of unequal length")
                points = integers(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, length), scale)
                trees = [grow(points[:, p * width : (p + 1) * width]) for p in range(parts)]
                whole = lambda column: pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), column)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [whole(own.column("vec_id")), whole(own.column("label")), pa.array([pack(points, trees)], pa.binary())],
                    names=["ids", "labels", "trees"],
                )

    return kept.mapInArrow(run, f"ids array<long>, labels array<{label}>, trees binary")


def improve(made: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the means of their parts, rounded down; unused ones stay."""
    importable(made.sparkSession)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                points, trees = unpack(data.as_py(), parts)
                for p, tree in enumerate(trees):
                    more, n = gathered(tree, points[:, p * width : (p + 1) * width], books[p])
                    sums[p] += more
                    counts[p] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts * entries)), pa.array(counts.ravel()), pa.array(list(sums.reshape(-1, width)), pa.list_(pa.int64()))],
            names=["entry", "n", "sums"],
        )

    partial = made.select("trees").mapInArrow(run, "entry long, n long, sums array<long>")
    # Sums over all rows may pass 64 bits.
    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    out = books.copy()
    for row in partial.groupBy("entry").agg(F.sum("n").alias("n"), *exact).filter("n > 0").collect():
        out[row.entry // entries, row.entry % entries] = [int(row[f"s{d}"]) // row.n for d in range(width)]
    return out


def coded(made: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    importable(made.sparkSession)
    parts, _, width = books.shape
    label = made.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*(batch.column(c) for c in ("ids", "labels", "trees")), strict=True):
                points, trees = unpack(data.as_py(), parts)
                codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
                for p, tree in enumerate(trees):
                    own = points[:, p * width : (p + 1) * width]
                    to = nearest(tree, own, books[p])
                    codes[:, p] = to
                    error += ((own - books[p][to]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return made.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, folder: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of the kept rows, and the codebooks (part, entry, position)."""
    folder = folder or shared_folder(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    kept = usable(vectors.withColumn("vec_id", F.col("vec_id").cast("long")))
    books = first_entries(kept, parts, entries, scale)
    if not books.size:
        return kept.filter(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    made = stored(blocks(kept, books.shape[2], parts, scale), folder, "trees")
    for _ in range(rounds):
        books = improve(made, books)
    return stored(coded(made, books), folder, "codes"), books


def op13_metric_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # One row a label; labels are joined by their value, and null with null.
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )

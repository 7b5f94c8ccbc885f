"""Embedding near-dedup: int8 tile products with rigorous quantisation error bounds.

Vectors of one label are dealt into blocks, equal ones collapsed before. A block is quantised once, when it is made: what
meets other blocks are int8 vectors, a scale and the true norm of the quantisation error of each, an eighth of the vectors
themselves. Each pair of blocks is a tile: the product of the int8 vectors (exact, as sums of small integers in float32)
plus a bound made from both errors tells which pairs may reach the threshold. Pairs that surely do are links; a tile
returns counts of them and a spanning forest, no larger than its blocks however many pairs link. Doubtful pairs alone
get the full vectors of their tile's blocks, a second time over the tiles that have any, and are recomputed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

THRESHOLD = 0.98
BLOCK = 1024
#: Pairs recomputed at a time, and dimensions up to which sums of products of int8 are exact in float32.
AT_ONCE, EXACT_DIMS = 1 << 18, 1040
#: Slack for rounding in double precision, added to the error bounds.
ROUNDING = 1e-9


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantised(x: np.ndarray) -> Quantised:
    """(q, scale, error): unit vectors as scale * q, q of int8 range, and the norm of what that leaves out."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def judged(a: Quantised, b: Quantised, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure): the pairs of rows of a and b that may reach the threshold, and whether they surely do."""
    (qa, sa, ea), (qb, sb, eb) = ((x[0].astype(np.float32), *x[1:]) for x in (a, b))
    if not len(qa) or not len(qb):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    product = sum((qa[:, k : k + EXACT_DIMS] @ qb[:, k : k + EXACT_DIMS].T for k in range(EXACT_DIMS, qa.shape[1], EXACT_DIMS)), (qa[:, :EXACT_DIMS] @ qb[:, :EXACT_DIMS].T).astype(np.float64 if qa.shape[1] > EXACT_DIMS else np.float32))
    # |u.v - su sv qu.qv| <= eu (1 + ev) + ev (1 + eu) + eu ev, as |s q| <= 1 + e. First a cheap test by row, then the pair's own.
    most = float(eb.max())
    least = (threshold - ROUNDING - (ea * (1 + most) + most * (1 + ea) + ea * most)) / (sa * float(sb.max()))
    i, j = np.nonzero(product >= np.minimum(least, 3e38).astype(np.float32)[:, None] * np.float32(1 - 1e-6) - np.float32(1))
    about = product[i, j].astype(np.float64) * sa[i] * sb[j]
    slack = ea[i] * (1 + eb[j]) + eb[j] * (1 + ea[i]) + ea[i] * eb[j] + ROUNDING
    at = about + slack >= threshold
    return i[at], j[at], (about - slack >= threshold)[at]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs of unit vectors a[i], b[j] reach the threshold, in double precision."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), AT_ONCE):
        out[k : k + AT_ONCE] = np.einsum("nd,nd->n", a[i[k : k + AT_ONCE]], b[j[k : k + AT_ONCE]]) >= threshold
    return out


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, recomputed): the pairs of rows of a and b with a cosine of at least threshold. Rows are unit vectors."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    i, j, sure = judged(quantised(a), quantised(b), threshold)
    keep, doubtful = sure.copy(), np.flatnonzero(~sure)
    keep[doubtful] = exact(a, b, i[doubtful], j[doubtful], threshold)
    return i[keep], j[keep], len(doubtful)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, for links between u and v."""
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors with length 1, whatever their range."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _quantised_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for r in range(rows.num_rows):
            n = len(rows.column("ids")[r])
            q, scale, error = quantised(unit(rows.column("vectors")[r].values.to_numpy().reshape(n, -1)))
            made = [pa.array([q.tobytes()], pa.binary()), *(pa.array([x], pa.list_(pa.float64())) for x in (scale, error))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(r, 1) for c in ("label", "dim", "blocks", "block", "ids", "copies")), *made], names=["label", "dim", "blocks", "block", "ids", "copies", "q", "scale", "error"])


def _linked(ia: np.ndarray, ca: np.ndarray, ib: np.ndarray, cb: np.ndarray, u: np.ndarray, v: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, links, root) of the rows that links between u of a and v of b give: their number for each node, and a forest."""
    n_a, n_b = np.bincount(u, cb[v], len(ia)).astype(np.int64), np.bincount(v, ca[u], len(ib)).astype(np.int64)
    ids, links = (ia, n_a + n_b) if same else (np.concatenate([ia, ib]), np.concatenate([n_a, n_b]))
    root = forest(len(ids), u, v if same else v + len(ia))
    at = links > 0
    return ids[at], links[at], ids[root[at]]


_FOUND = "label string, dim int, i int, j int, at array<long>, links array<long>, root array<long>, u array<int>, v array<int>"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tile: what its sure links give, and its doubtful pairs."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("at", "links", "root")), *((c, pa.list_(pa.int32())) for c in ("u", "v"))])
    for rows in batches:
        for r in range(rows.num_rows):
            get = lambda c: np.asarray(rows.column(c)[r].values)  # noqa: B023, E731
            i, j = rows.column("i")[r].as_py(), rows.column("j")[r].as_py()
            a, b = ((np.frombuffer(rows.column(f"{x}_q")[r].as_buffer(), np.int8).reshape(len(get(f"{x}_ids")), -1), get(f"{x}_scale"), get(f"{x}_error")) for x in "ab")
            u, v, sure = judged(a, b)
            if i == j:
                once = u < v
                u, v, sure = u[once], v[once], sure[once]
            at, links, root = _linked(get("a_ids"), get("a_copies"), get("b_ids"), get("b_copies"), u[sure], v[sure], i == j)
            values = [rows.column("label")[r].as_py(), rows.column("dim")[r].as_py(), i, j, at, links, root, u[~sure], v[~sure]]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


def _recomputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the doubtful pairs of tiles give, from the full vectors."""
    for rows in batches:
        for r in range(rows.num_rows):
            get = lambda c: np.asarray(rows.column(c)[r].values)  # noqa: B023, E731
            a, b = (unit(get(f"{x}_vectors").reshape(len(get(f"{x}_ids")), -1)) for x in "ab")
            u, v = get("u"), get("v")
            keep = exact(a, b, u, v)
            same = rows.column("i")[r].as_py() == rows.column("j")[r].as_py()
            found = _linked(get("a_ids"), get("a_copies"), get("b_ids"), get("b_copies"), u[keep], v[keep], same)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["at", "links", "root"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have the same length, and the cosine reaches
    THRESHOLD. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    without a vec_id (component_id null, kept false). Each row counts as a vector, repeated rows too; different vectors under
    one vec_id are different vectors, each with its own links and component. An empty table gives no rows; other columns are
    not carried.
    """
    # cast to double first: a float that is not finite stays so, and zero stays zero
    sound = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).alias("sound"))
    rows = cut(rows.withColumn("eh", F.when(F.col("sound"), F.md5(F.to_json("embedding").cast("binary")))), "vectors")
    different = rows.where("sound").groupBy("label", "eh", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    different = cut(different.select("*", F.size("embedding").alias("dim"), F.xxhash64("label", "eh").alias("node")), "different")
    blocks = different.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = different.join(blocks, ["label", "dim"]).withColumn("block", F.pmod("node", F.col("blocks")).cast("int"))
    # a block holds about BLOCK vectors, whatever the label's share
    packed = dealt.groupBy("label", "dim", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("node", "copies", "embedding"))).alias("x"))
    packed = cut(packed.select(F.to_json(F.struct("label")).alias("label"), "dim", "blocks", "block", F.col("x.node").alias("ids"), F.col("x.copies").alias("copies"), F.flatten("x.embedding").alias("vectors")), "blocks")
    small = packed.mapInArrow(_quantised_blocks, "label string, dim int, blocks int, block int, ids array<long>, copies array<long>, q binary, scale array<double>, error array<double>")
    small = cut(small, "quantised")
    part = ("ids", "copies", "q", "scale", "error")
    left = small.select("label", "dim", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), *(F.col(c).alias(f"a_{c}") for c in part))
    right = small.select("label", "dim", F.col("block").alias("j"), *(F.col(c).alias(f"b_{c}") for c in part))
    tiles = cut(left.join(right, ["label", "dim", "j"]).mapInArrow(_tiles, _FOUND), "tiles")
    sure = tiles.select(F.explode(F.arrays_zip("at", "links", "root")).alias("x")).select("x.at", "x.links", "x.root")
    doubtful = tiles.where("size(u) > 0").select("label", "dim", "i", "j", "u", "v")
    full = lambda x, c: packed.select("label", "dim", F.col("block").alias(c), *(F.col(y).alias(f"{x}_{y}") for y in ("ids", "copies", "vectors")))
    both = doubtful.join(full("a", "i"), ["label", "dim", "i"]).join(full("b", "j"), ["label", "dim", "j"])
    found = cut(sure.union(both.mapInArrow(_recomputed, "at long, links long, root long")), "links")
    links = found.groupBy("at").agg(F.sum("links").alias("links"))
    named = components(found.select("at", "root"), "at", "root").select(F.col("node").alias("of"), "component")
    reps = different.select("label", "eh", "rep", "copies", "node").join(links, F.col("node") == F.col("at"), "left").join(named, F.col("node") == F.col("of"), "left")
    reps = cut(reps.select("label", "eh", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")), "nodes")
    least = reps.groupBy(F.col("c").alias("least_of")).agg(F.min("rep").alias("component_id"))
    reps = reps.join(least, F.col("c") == F.col("least_of")).select(F.col("label").alias("l"), F.col("eh").alias("e"), "n_links", "component_id")
    out = rows.select("vec_id", "label", "eh").join(reps, (F.col("label") == F.col("l")) & (F.col("eh") == F.col("e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

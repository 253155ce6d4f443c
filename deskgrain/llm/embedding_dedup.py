"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one kept for each group.

No link is lost between cells: a vector also visits each cell of a smaller number that a partner of it could live in. If
x lives in cell d its product with centre d is not below that with any centre e; a cosine of t or more means a distance of
sqrt(2 - 2 t) or less, so a partner y of x lies within that distance of every plane between d and another centre e:
(y.e - y.d) / |e - d| does not exceed it. How often vectors visit is measured on the sample that the centres are fitted
on: cells are as many as the vectors ask for, or fewer if vectors would stand in more than a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .graph import connected_components, union
from .vectors import kmeans, sample, takes_part, to_matrix

#: Vectors in a block, vectors of a label in each cell (about), most cells, and cells that a vector stands in at most on average.
BLOCK, PER_CELL, CELLS, STANDS = 8_192, 2_000, 512, 3.0


def _reach(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each row of unit vectors ``x``; rows and cells of their visits to cells of a smaller number)."""
    reach, gaps = _reach(threshold), np.linalg.norm(centres[:, None] - centres[None], axis=2)
    p = x @ centres.T
    home = p.argmax(1)
    gap = p[np.arange(len(p)), home][:, None] - p
    row, cell = np.nonzero((gap <= reach * gaps[home]) & (np.arange(len(centres)) < home[:, None]))
    near = np.ones(len(row), bool)
    for i in range(0, len(row), 8_192):  # the planes to all other centres
        r, c = row[i : i + 8_192], cell[i : i + 8_192]
        near[i : i + 8_192] = (p[r] - p[r, c][:, None] <= reach * gaps[c] + 1e-12).all(1)
    return home, row[near], cell[near]


def fitted(x: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Centres for the sample ``x``: ``most`` of them, or half as many until vectors stand in STANDS cells or fewer."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    while True:
        centres = kmeans(x, most, spherical=True)
        if len(centres) == 1 or 1 + len(visits(x, centres, threshold)[1]) / len(x) <= STANDS:
            return centres
        most = len(centres) // 2


def _placed(centres: np.ndarray, threshold: float):
    """Rows (rep, v, label, n, width) at their cell and as guests of others; vectors of another length share cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            main = np.asarray(b.column(4)) == centres.shape[1]
            if not main.all():
                other = b.filter(pa.array(~main))
                zero = pa.array(np.zeros(other.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays([*other.columns, zero, zero], names=[*b.schema.names, "cell", "guest"])
            if not main.any():
                continue
            b = b.filter(pa.array(main))
            x = to_matrix(b.column(1))
            home, row, cell = visits(x / np.linalg.norm(x, axis=1, keepdims=True), centres, threshold)
            row, cell, guest = np.concatenate((np.arange(len(x)), row)), np.concatenate((home, cell)), np.repeat([0, 1], [len(x), len(row)])
            took = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*took.columns, pa.array(cell.astype(np.int32)), pa.array(guest.astype(np.int32))],
                names=[*b.schema.names, "cell", "guest"],
            )

    return run


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.column(0):
                sides = []
                for side in pair:
                    items = side["items"].values
                    x = to_matrix(items.field("v"))
                    sides.append((np.asarray(items.field("rep")), np.asarray(items.field("n")), x / np.linalg.norm(x, axis=1, keepdims=True)))
                (ia, na, a), (ib, nb, b), same = sides[0], sides[-1], len(sides) == 1
                ids = ia if same else np.concatenate((ia, ib))
                label, degree, shift = np.arange(len(ids)), np.zeros(len(ids), np.int64), 0 if same else len(ia)
                for i in range(0, len(a), 512):
                    x, y = np.nonzero(a[i : i + 512] @ b.T >= threshold)
                    x = x + i
                    if same:
                        x, y = x[x < y], y[x < y]
                    if len(x):
                        np.add.at(degree, x, nb[y])
                        np.add.at(degree, y + shift, na[x])
                        union(label, x, y + shift)
                linked, moved = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids[linked], ids[moved]))),
                        pa.array(np.concatenate((degree[linked], np.zeros(len(moved), np.int64)))),
                        pa.array(np.concatenate((ids[linked], ids[label[moved]]))),
                    ],
                    names=["rep", "links", "root"],
                )

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id and kept (whether it represents its component).

    Two vectors link if their labels are equal and not null, they have the same length and their cosine is at least
    ``threshold``. Vectors that are null, zero or hold null or non-finite components link with nothing. Those of the commonest
    length are dealt into cells; those of another are one cell of each label. Equal vectors are compared once and counted each. Rows may repeat (a repeated
    row is another vector); a null id never represents others unless no id is there; an empty table gives an empty
    result. ``label_col`` None compares all with all.
    """
    label = F.lit(0) if label_col is None else F.col(label_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), label.alias("label"))
    good = rows.where(takes_part(F.col("v")) & F.col("label").isNotNull())
    length = good.agg(F.mode(F.size("v"), deterministic=True)).first()[0]
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", "label").alias("k2")]
    good = good.select("id", "v", "label", *key)
    # equal vectors once; a vector is named by a number of its own, as ids may be null or repeat
    distinct = good.groupBy("k1", "k2").agg(
        F.min("id").alias("least"), F.any_value("v").alias("v"), F.any_value("label").alias("label"), F.count("*").alias("n"),
    )
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "distinct-vectors")
    largest = distinct.where(F.col("width") == (length or 0)).groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if not largest:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    centres = fitted(
        sample(distinct.where(F.col("width") == length).withColumn("h", F.xxhash64("k1", "k2")), "h", "v"),
        min(CELLS, -(-largest // PER_CELL)), threshold,
    )
    kinds = dict(distinct.dtypes)
    placed = distinct.select("rep", "v", "label", "n", "width").mapInArrow(
        _placed(centres, threshold), f"rep long, v {kinds['v']}, label {kinds['label']}, n long, width int, cell int, guest int",
    )
    placed = written(placed, "vector-cells")
    cell = ["label", "width", "cell"]
    sizes = placed.groupBy(*cell).agg(*[F.ceil(F.count_if(F.col("guest") == g) / BLOCK).cast("int").alias(f"b{g}") for g in (0, 1)])
    dealt = placed.join(small(written(sizes, "cell-sizes")), cell).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.when(F.col("guest") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int"),
    )
    blocks = dealt.groupBy(*cell, "guest", "block").agg(
        F.any_value("b0").alias("b0"), F.any_value("b1").alias("b1"), F.collect_list(F.struct("rep", "n", "v")).alias("items"),
    )  # bounded by BLOCK
    def numbered(guest: int, n) -> F.Column:
        return F.when(
            n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.struct(F.lit(guest).alias("guest"), q.alias("block"))),
        ).otherwise(F.array().cast("array<struct<guest:int,block:int>>"))
    own, other = F.struct("guest", "block"), F.col("other")
    partners = F.when(F.col("guest") == 0, F.concat(numbered(0, F.col("b0")), numbered(1, F.col("b1")))).otherwise(numbered(0, F.col("b0")))
    met = blocks.withColumn("other", F.explode(partners)).select(
        *cell, F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), own.alias("who"), "items",
    ).groupBy(*cell, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("who", "items"))).alias("t"))
    found = written(met.select("t").mapInArrow(_compare(threshold), "rep long, links long, root long"), "vector-links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = connected_components(found.where("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    named = distinct.join(degree, "rep", "left").join(rooted, distinct["rep"] == rooted["node"], "left").select(
        "k1", "k2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("root"),
    )
    named = written(named, "vector-components")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("k1", "k2", "n_links", "component_id")
    keyed = rows.select("id", *[F.when(takes_part(F.col("v")) & F.col("label").isNotNull(), k).alias(f"r{i}") for i, k in enumerate(key)])
    out = keyed.join(named, (F.col("r0") == F.col("k1")) & (F.col("r1") == F.col("k2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )

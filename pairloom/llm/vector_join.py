"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine s lie sqrt(2 - 2s) apart. On any orthonormal directions they lie no
further apart, so a grid of that cell width on leading principal directions puts linked vectors
in equal or neighbouring cells. All vectors of a label are sorted by their cells and cut into
sequence intervals; intervals whose boxes are provably too far apart never meet, the others are
joined by halving both until they are small or provably distant. The rest is exact: cosines in
double precision.

Equal vectors of a label are one node with a multiplicity. A joined pair of intervals returns
counts of links and edges that span its components, not all its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import components
from pairloom.session import materialize

DIRECTIONS = 6
KEY_CELLS = 2
SAMPLE = 20_000
INTERVAL = 512
LEAF = 64


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Rows of a list column in double precision; None for null rows and rows with null parts."""
    out: list[np.ndarray | None] = []
    for cell in column:
        if not cell.is_valid or cell.values.null_count:
            out.append(None)
        else:
            out.append(cell.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0)
    return out


def usable(vector: np.ndarray | None) -> bool:
    """Vectors that can link: finite, not zero, with a finite norm."""
    if vector is None or not len(vector) or not np.isfinite(vector).all():
        return False
    return 0 < np.linalg.norm(vector / np.abs(vector).max()) if np.abs(vector).max() > 0 else False


def unit_vector(vector: np.ndarray) -> np.ndarray:
    scaled = vector / np.abs(vector).max()
    return scaled / np.linalg.norm(scaled)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, node (null if it can link with nothing), unit vector per row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            nodes, units = [], []
            for label, vector in zip(labels, vectors_of(batch.column("embedding")), strict=True):
                if label is None or not usable(vector):
                    nodes.append(None)
                    units.append(None)
                else:
                    name = hashlib.md5(str(label).encode() + b":" + vector.tobytes())
                    nodes.append(name.digest())
                    units.append(unit_vector(vector).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(nodes, pa.binary()),
                    pa.array(units, pa.binary()),
                ],
                ["vec_id", "label", "node", "unit"],
            )

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    return rows.mapInArrow(made, "vec_id long, label string, node binary, unit binary")


def principal_directions(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each dimension in a sample of SAMPLE nodes.

    The sample only decides how well the grid separates; the join is exact with any directions.
    """
    rows = nodes.select("unit").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
    by_size: dict[int, list[np.ndarray]] = {}
    for cell in rows["unit"].to_pylist():
        vector = np.frombuffer(cell)
        by_size.setdefault(len(vector), []).append(vector)
    out = {}
    for size, sample in by_size.items():
        table = np.stack(sample)
        _, directions = np.linalg.eigh(np.cov(table.T, bias=True).reshape(size, size))
        out[size] = directions[:, ::-1][:, :DIRECTIONS]
    return out


def project(unit: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading directions, padded with zeros."""
    axes = directions.get(len(unit))
    if axes is None:
        axes = np.eye(len(unit))[:, :DIRECTIONS]
    out = np.zeros(DIRECTIONS)
    out[: axes.shape[1]] = unit @ axes
    return out


def join_intervals(
    a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, least: float, reach: float
) -> np.ndarray:
    """Which rows of a and b link: intervals are halved, distant halves skipped."""
    out = np.zeros((len(a), len(b)), bool)
    open_pairs = [(0, len(a), 0, len(b))]
    while open_pairs:
        i, k, j, m = open_pairs.pop()
        low_a, high_a = at_a[i:k].min(0), at_a[i:k].max(0)
        low_b, high_b = at_b[j:m].min(0), at_b[j:m].max(0)
        gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
        if gap @ gap > reach * reach:
            continue
        if k - i <= LEAF and m - j <= LEAF:
            out[i:k, j:m] = a[i:k] @ b[j:m].T >= least
        elif k - i >= m - j:
            half = (i + k) // 2
            open_pairs += [(i, half, j, m), (half, k, j, m)]
        else:
            half = (j + m) // 2
            open_pairs += [(i, k, j, half), (i, k, half, m)]
    return out


def spanning_edges(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what ``links`` connects, fewer than rows plus columns.

    Breadth first, a whole level at a time: every row and column is looked through once, however
    many links it has. With ``same`` rows and columns are the same vectors.
    """
    if same:
        links = links | links.T
    back = links.T
    open_rows = links.any(1)
    open_cols = open_rows if same else links.any(0)
    out: list[tuple[int, int]] = []

    def reached(table: np.ndarray, level: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = table[level]
        new = np.flatnonzero(own.any(0) & unseen)
        unseen[new] = False
        return new, level[own[:, new].argmax(0)]

    while open_rows.any():
        level = np.array([open_rows.argmax()])
        open_rows[level] = False
        while len(level):
            cols, rows = reached(links, level, open_cols)
            out += zip(rows.tolist(), cols.tolist(), strict=True)
            if same or not len(cols):
                level = cols
            else:
                level, cols = reached(back, cols, open_rows)
                out += zip(level.tolist(), cols.tolist(), strict=True)
    return out


def _intervals(nodes: DataFrame, directions: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Sequence intervals of the grid order: label, size, box, cells, nodes and unit vectors."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [project(np.frombuffer(u), directions) for u in batch.column("unit").to_pylist()]
            table = np.stack(at) if at else np.zeros((0, DIRECTIONS))
            cells = np.floor(table / reach).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(u.as_py()) // 8 for u in batch.column("unit")], pa.int32()),
                    pa.array([r.tobytes() for r in table], pa.binary()),
                    *[pa.array(cells[:, d]) for d in range(DIRECTIONS)],
                ],
                [*batch.schema.names, "size", "at", *[f"c{d}" for d in range(DIRECTIONS)]],
            )

    cells = [f"c{d}" for d in range(DIRECTIONS)]
    order = ["label", "size", *cells, "node"]
    fields = "label string, node binary, copies long, unit binary, size int, at binary"
    sorted_nodes = (
        nodes.select("label", "node", "copies", "unit")
        .mapInArrow(placed, fields + "".join(f", {c} int" for c in cells))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("label", "size", "node", "copies", "unit", "at")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            at = np.stack([np.frombuffer(r[5]) for r in held])
            low, high = at.min(0), at.max(0)
            row = {
                "interval": (part << 32) + made,
                "label": held[0][0],
                "size": held[0][1],
                "low": low.tolist(),
                "high": high.tolist(),
                "cell_low": np.floor(low / reach).astype(int).tolist(),
                "cell_high": np.floor(high / reach).astype(int).tolist(),
                "nodes": [r[2] for r in held],
                "copies": [r[3] for r in held],
                "units": b"".join(r[4] for r in held),
                "at": at.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == INTERVAL or held[0][:2] != row[:2]):
                    yield done()
                    held, made = [], made + 1
                held.append(row)
        if held:
            yield done()

    schema = pa.schema(
        [
            ("interval", pa.int64()),
            ("label", pa.string()),
            ("size", pa.int32()),
            ("low", pa.list_(pa.float64())),
            ("high", pa.list_(pa.float64())),
            ("cell_low", pa.list_(pa.int32())),
            ("cell_high", pa.list_(pa.int32())),
            ("nodes", pa.list_(pa.binary())),
            ("copies", pa.list_(pa.int64())),
            ("units", pa.binary()),
            ("at", pa.binary()),
        ]
    )
    return sorted_nodes.mapInArrow(
        cut,
        "interval long, label string, size int, low array<double>, high array<double>, "
        "cell_low array<int>, cell_high array<int>, nodes array<binary>, copies array<long>, "
        "units binary, at binary",
    )


def _meeting(intervals: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of intervals of one label and size whose boxes are within reach.

    They meet on the cells of the first directions: an interval stands in the cells that its box
    covers, and looks into those and their neighbours.
    """
    boxes = intervals.select("interval", "label", "size", "low", "high", "cell_low", "cell_high")

    def on_cells(df: DataFrame, wider: int) -> DataFrame:
        for d in range(KEY_CELLS):
            first, last = F.col("cell_low")[d] - wider, F.col("cell_high")[d] + wider
            df = df.withColumn(f"k{d}", F.explode(F.sequence(first, last)))
        return df.drop("cell_low", "cell_high")

    keys = ["label", "size", *[f"k{d}" for d in range(KEY_CELLS)]]
    a = on_cells(boxes, 0).toDF("a", "label", "size", "low_a", "high_a", *keys[2:])
    b = on_cells(boxes, 1).toDF("b", "label", "size", "low_b", "high_b", *keys[2:])
    gap = F.aggregate(
        F.transform(
            F.arrays_zip("low_a", "high_a", "low_b", "high_b"),
            lambda x: F.greatest(
                F.lit(0.0), x["low_b"] - x["high_a"], x["low_a"] - x["high_b"]
            ),
        ),
        F.lit(0.0),
        lambda total, g: total + g * g,
    )
    return a.join(b, keys).where((F.col("a") <= F.col("b")) & (gap <= reach * reach)).select("a", "b").distinct()


def _joined(intervals: DataFrame, pairs: DataFrame, least: float, reach: float) -> DataFrame:
    """Per meeting pair: rows (node, n, other): n links of a node, or an edge to another node."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same, size = row["a"] == row["b"], row["size"]
                a = np.frombuffer(row["units_a"]).reshape(-1, size)
                b = np.frombuffer(row["units_b"]).reshape(-1, size)
                at_a = np.frombuffer(row["at_a"]).reshape(len(a), -1)
                at_b = np.frombuffer(row["at_b"]).reshape(len(b), -1)
                links = join_intervals(a, b, at_a, at_b, least, reach)
                if same:
                    np.fill_diagonal(links, False)
                nodes_a, nodes_b = row["nodes_a"], row["nodes_b"]
                sides = [(nodes_a, links @ np.array(row["copies_b"]))]
                if not same:
                    sides.append((nodes_b, np.array(row["copies_a"]) @ links))
                out = [
                    (nodes[i], int(n[i]), None) for nodes, n in sides for i in np.flatnonzero(n)
                ]
                out += [(nodes_a[i], 0, nodes_b[j]) for i, j in spanning_edges(links, same)]
                if out:
                    node, n, other = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(other, pa.binary())],
                        ["node", "n", "other"],
                    )

    own = intervals.select("interval", "size", "nodes", "copies", "units", "at")
    a = own.toDF("a", "size", "nodes_a", "copies_a", "units_a", "at_a")
    b = own.drop("size").toDF("b", "nodes_b", "copies_b", "units_b", "at_b")
    return pairs.join(a, "a").join(b, "b").mapInArrow(linked, "node binary, n long, other binary")


def vector_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal, not null label and equal length are linked from cosine ``least`` on;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    reachable by links, itself included, and ``kept`` says that it is the row's own. Null and
    zero vectors, and those with null or non-finite parts, link with nothing. Rows with equal
    vectors are linked whatever their ids; a null id is no component id unless there is no
    other. Other columns are left out; an empty table gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    rows = materialize(prepared(vectors), "vectors")
    nodes = materialize(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.count("*").alias("copies"),
            F.min("vec_id").alias("vec_id"),
            F.first("unit").alias("unit"),
        ),
        "nodes",
    )
    reach = float(np.sqrt(2 - 2 * least) + 1e-6)
    intervals = materialize(_intervals(nodes, principal_directions(nodes), reach), "intervals")
    pairs = materialize(_meeting(intervals, reach), "pairs")
    found = materialize(_joined(intervals, pairs, least, reach), "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "copies", "vec_id").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    per_node = (
        named.join(smallest, "root")
        .join(counts, "node", "left")
        .select(
            F.col("node").alias("_node"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "component_id",
        )
    )
    single = F.col("node").isNull()
    return (
        rows.select("vec_id", "node")
        .join(per_node, F.col("node") == F.col("_node"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(single, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )

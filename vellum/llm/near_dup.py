"""MinHash near-duplicate groups by a signature-coordinate inverted join.

Every distinct shingle set (a node; equal sets collapse to one before anything is joined) gets a MinHash signature. A node
is posted under each of its (coordinate, value) pairs. Sets that share at least `matches` of `coordinates` values must
share one among the `coordinates - matches + 1` rarest of either (prefix filter), so only those postings are merged and
the long lists of common values are skipped. Inside a list, breadth-first search over the signatures emits a spanning
forest of the nodes whose collisions reach `matches`, never all pairs. The resulting candidate clusters then get their
full shingle sets, and the same search confirms links exactly: 100 * |A and B| >= percent * |A or B|.

Lists and clusters above a block size are searched as pairs of blocks, so no task holds an unbounded group and no pair is
lost. Results: a node without words is linked with nothing; null texts count as empty; rows with equal doc_id are separate
rows; a component's id is its least non-null doc_id (null if there is none).

Recall: at a similarity of 0.8 the count of equal coordinates of 64 is binomial with mean 51.2, and `matches` = 36 lies
4.7 standard deviations below it, which misses about one link in 10^5, and connected copies have many links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.shared import cut, map_arrow, ship, texts_of
from vellum.llm.wordgrid import Grid, shingles, stream

COORDINATES, MATCHES, PERCENT = 64, 36, 80
#: Postings lists and candidate clusters above these numbers of nodes are searched in pairs of blocks of that size.
LIST_BLOCK, CLUSTER_BLOCK = 4096, 1536
#: Bytes of text of such a block of a cluster.
BLOCK_BYTES = 16_000_000


def node_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The least of each of the multiply-shift hashes, in chunks that bound memory for very long texts."""
    scale, shift = stream(coordinates, 11) | np.uint64(1), stream(coordinates, 13)
    least = np.full(coordinates, np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 8192):
            hashed = ((found[None, at : at + 8192] * scale[:, None] + shift[:, None]) >> np.uint64(32)).astype(np.uint32)
            np.minimum(least, hashed.min(axis=1), out=least)
    return least


def _signatures(words: int, coordinates: int):
    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            grid = Grid(texts, lower=True)
            hashes, sizes, nodes, marks = grid.hashes(), [], [], []
            for a, b in zip(grid.doc_at[:-1], grid.doc_at[1:], strict=True):
                found = shingles(hashes[a:b], words)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                marks.append(signature(found, coordinates).tobytes() if len(found) else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("own"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "row_key", "own", "n_shingles", "node", "signature", "bytes"])

        return apply

    return make


def _forest(of: list, near) -> Iterator[tuple]:
    """(root, member) edges of a spanning forest; near(x, others) gives those of the indices `others` linked with x."""
    left = np.arange(len(of))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            hit = near(queue.pop(), left)
            for x in left[hit]:
                yield of[root], of[x]
            queue.extend(left[hit])
            left = left[~hit]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, from batches sorted by keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["a", "b"])


def _merge_lists(matches: int, coordinates: int):
    """Edges between nodes of one list whose signatures agree in `matches` coordinates. A list of two, by far the most
    frequent, is compared with all other such lists of the batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()
                if not rows:
                    continue
                rows = rows[0]
                keys = [np.asarray(rows.column(k)) for k in ("cv", "i", "j")]
                change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                cut_at = int(change[-1]) if len(change) else 0
                held = rows.slice(cut_at)
                if cut_at:
                    yield rows.slice(0, cut_at)
            if held is not None:
                yield held

        for rows in grouped():
            keys = [np.asarray(rows.column(k)) for k in ("cv", "i", "j")]
            ids = np.asarray(rows.column("nid"))
            marks = np.frombuffer(b"".join(rows.column("mark").to_pylist()), dtype=np.uint8).reshape(-1, coordinates)
            edges = np.concatenate(([0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, [rows.num_rows]))
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[(marks[two] == marks[two + 1]).sum(axis=1) >= matches] if len(two) else two
            pairs = list(zip(ids[two].tolist(), ids[two + 1].tolist(), strict=True))
            for a, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = marks[a : a + n]
                pairs += _forest(ids[a : a + n].tolist(), lambda x, others, own=own: (own[others] == own[x]).sum(axis=1) >= matches)
            if pairs:
                yield _edges(list(dict.fromkeys(pairs)), pa.int64())

    return run


def _confirm(words: int, percent: int):
    """Edges between nodes of one cluster that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["cluster", "i", "j"]):
            grid = Grid([x or "" for x in rows.column("text").to_pylist()], lower=True)
            hashes = grid.hashes()
            sets, nodes = [], []
            for a, b, expected in zip(grid.doc_at[:-1], grid.doc_at[1:], rows.column("node").to_pylist(), strict=True):
                found = shingles(hashes[a:b], words)
                if node_of(found) == expected:  # another row may share a 64-bit row key
                    sets.append(found)
                    nodes.append(expected)
            if len(sets) < 2:
                continue
            size = np.array([len(s) for s in sets], dtype=np.int64)
            vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate(([0], np.cumsum(size)))
            seen = np.zeros(len(vocabulary), dtype=bool)

            def near(x, others, size=size, flat=flat, at=at, seen=seen):
                linked = (100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])).copy()
                picked = others[linked]
                if not len(picked):
                    return linked
                own = flat[at[x] : at[x + 1]]
                seen[own] = True
                starts = np.concatenate(([0], np.cumsum(size[picked])))
                inside = np.repeat(at[picked] - starts[:-1], size[picked]) + np.arange(starts[-1])
                both = np.add.reduceat(seen[flat[inside]].astype(np.int64), starts[:-1])
                seen[own] = False
                linked[linked] = 100 * both >= percent * (size[picked] + size[x] - both)
                return linked

            pairs = list(_forest(nodes, near))
            if pairs:
                yield _edges(pairs, pa.binary())

    return run


def _in_blocks(df: DataFrame, blocks: Column, by: str) -> DataFrame:
    """Adds i, j: a group of one block stays whole (0, 0); a row of a larger one goes to every pair of blocks with its own."""
    n = blocks.cast("int")
    own = F.pmod(F.xxhash64(F.col(by), F.lit(17)), n).cast("int")
    pairs = F.when(n <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    )
    return df.withColumn("pair", F.explode(pairs)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes of each row, by which it is met again."""
    return docs.withColumns({"row_key": F.xxhash64("doc_id", "text"), "own": F.xxhash64("text", F.lit(3))})


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """docs: doc_id, text and any other columns. Returns one row per row of docs: doc_id, row_key, n_shingles, node (null
    without words), component (null without words), component_id, kept (doc_id = component_id, null-safe)."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select("doc_id", "text")
    base = cut(
        map_arrow(keyed(source), _signatures(words, coordinates), "doc_id long, row_key long, own long, n_shingles long, node binary, signature binary, bytes long"),
        "signatures",
    )
    # one row a distinct set; sets under this size are linked only with equal ones
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    nodes = cut(
        base.where(F.col("n_shingles") >= least).groupBy("node").agg(F.min(F.struct("row_key", "own", "signature", "bytes")).alias("x"))
        .select("node", F.col("x.row_key").alias("row_key"), F.col("x.own").alias("own"), F.col("x.signature").alias("signature"), F.col("x.bytes").alias("bytes"), F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long").alias("nid")),
        "nodes",
    )
    coordinate = F.sequence(F.lit(0), F.lit(coordinates - 1))
    value = lambda c: F.conv(F.hex(F.substring("signature", 4 * c + 1, 4)), 16, 10).cast("long")
    posts = nodes.select("nid", F.explode(F.transform(coordinate, lambda c: F.shiftleft(c.cast("long"), 32) + value(c))).alias("cv"))
    # counted by partial sums and joined back, so that a value of very many nodes is summed where it is met and can be split
    shared = posts.join(posts.groupBy("cv").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "cv")
    own = Window.partitionBy("nid")
    prefix = (
        shared.withColumns({"rank": F.row_number().over(own.orderBy("freq", "cv")), "n": F.count(F.lit(1)).over(own)})
        .where(F.col("rank") <= (coordinates - matches + 1) - (coordinates - F.col("n")))
        .select("nid", "cv", "freq")
    )
    marks = nodes.select("nid", F.unhex(F.array_join(F.transform(coordinate, lambda c: F.hex(F.substring("signature", 4 * c + 1, 1))), "")).alias("mark"))
    lists = _in_blocks(prefix.join(marks, "nid"), F.ceil(F.col("freq") / F.lit(LIST_BLOCK)), "nid").select("cv", "i", "j", "nid", "mark")
    lists = lists.repartition("cv", "i", "j").sortWithinPartitions("cv", "i", "j", "nid")
    candidates = components(lists.mapInArrow(_merge_lists(matches, coordinates), "a long, b long"))

    # of rows that agree in id and text one is read again, before any join
    texts = keyed(source).groupBy("row_key", "own").agg(F.first("text").alias("text"))
    labelled = candidates.select(F.col("node").alias("nid"), F.col("label").alias("cluster")).join(nodes.select("nid", "node", "row_key", "own", "bytes"), "nid")
    sizes = labelled.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(CLUSTER_BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).alias("blocks"))
    with_text = labelled.join(sizes, "cluster").select("row_key", "own", "node", "cluster", "blocks").join(texts, ["row_key", "own"])
    blocks = _in_blocks(with_text, F.col("blocks"), "node").select("cluster", "i", "j", "node", "text")
    blocks = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    labels = components(blocks.mapInArrow(_confirm(words, percent), "a binary, b binary"))

    of_node = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_node = of_node.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    of_component = of_node.groupBy("component").agg(F.min("least").alias("component_least"))
    found = cut(of_node.join(of_component, "component").select("node", "component", "component_least"), "classes")
    return base.join(found, "node", "left").select(
        "doc_id",
        "row_key",
        "n_shingles",
        "node",
        "component",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_least")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id; of rows that repeat both doc_id and text, one.
    Documents without words stay. All columns are returned."""
    found = near_duplicates(docs, words, percent).where("kept")
    # one row for each (set, doc_id); a component without any doc_id keeps one set only
    of_null = F.when(F.col("doc_id").isNull() & F.col("node").isNotNull(), F.col("component")).otherwise(F.col("node"))
    chosen = found.where("node is not null").groupBy(of_null.alias("g"), "doc_id").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
    key, nth, columns = "__vellum_key", "__vellum_nth", docs.columns
    keys = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = Window.partitionBy(key, "doc_id", F.xxhash64("text", F.lit(3))).orderBy(F.lit(1))
    with_words = keys.where(has_word).join(chosen.withColumnRenamed("row_key", key), key, "left_semi").withColumn(nth, F.row_number().over(own)).where(F.col(nth) == 1)
    return with_words.select(columns).unionByName(docs.where(~has_word))

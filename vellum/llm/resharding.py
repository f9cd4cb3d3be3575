"""Minimum-cost-flow resharding: from a layout of rows in old shards to new shards of near-equal bytes, moving least.

Rows carry an old shard. Each old shard is a set of blocks, by a hash of the text, and a block a set of parts, by row. Equal texts
share a block; blocks are poured into new shards part by part, so equal texts stay together but where a shard is full. The
sizes of parts, a bounded number whatever the input, come to the driver. There, a minimum-cost flow from old shards (their bytes) to new shards (their
capacities), with cost 0 for staying and 1 a byte for moving, says how many bytes each old shard gives to each new one;
blocks are picked to make up those amounts. The assignment joins back through a broadcast table of blocks.

Sizes end near equal: within about one block, of which there are thousands, or one document if that is larger. Slots are
numbered without gaps by shard: blocks get offsets from their counts, and rows are numbered inside blocks, so no task
sorts a shard. Null texts count as empty (size 1, crc 0). Rows that repeat stay separate rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import cut

#: Blocks of an old shard, and parts of a block.
BLOCKS, PARTS = 256, 32


class Flow:
    """Minimum-cost flow by successive shortest paths (Bellman and Ford), on integers."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = []  # to, capacity left, cost; the arc at i ^ 1 is its reverse
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost)"""
        flow = cost = 0
        while True:
            far, by = {source: 0}, {}
            queue = [source]
            while queue:
                a = queue.pop(0)
                for i in self.out[a]:
                    b, left, price = self.arcs[i]
                    if left > 0 and far[a] + price < far.get(b, float("inf")):
                        far[b], by[b] = far[a] + price, i
                        queue.append(b)
            if sink not in far:
                return flow, cost
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.arcs[by[at] ^ 1][0]
            push = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= push
                self.arcs[i ^ 1][1] += push
            flow, cost = flow + push, cost + push * far[sink]


def transfers(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, moving the fewest. A shard of the same number is the same place. The
    capacities must hold the sizes."""
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the new shards can't hold the old ones")
    olds, news = sorted(sizes), sorted(capacities)
    graph, source, sink = Flow(len(olds) + len(news) + 2), len(olds) + len(news), len(olds) + len(news) + 1
    for i, o in enumerate(olds):
        graph.arc(source, i, sizes[o], 0)
    for j, n in enumerate(news):
        graph.arc(len(olds) + j, sink, capacities[n], 0)
    arcs = {(o, n): graph.arc(i, len(olds) + j, sizes[o], int(o != n)) for i, o in enumerate(olds) for j, n in enumerate(news)}
    graph.run(source, sink)
    return {k: graph.arcs[i + 1 if i % 2 == 0 else i][1] for k, i in arcs.items() if graph.arcs[i ^ 1][1]}


def capacities_of(total: int, shards: int) -> dict[int, int]:
    return {n: total // shards + (n < total % shards) for n in range(shards)}


def least_moved(blocks: dict[tuple, int], shards: int) -> int:
    """Bytes that any layout of even shards moves at least."""
    sizes: dict[int, int] = defaultdict(int)
    for key, size in blocks.items():
        sizes[key[0]] += size
    return sum(n for (o, s), n in transfers(sizes, capacities_of(sum(sizes.values()), shards)).items() if o != s)


def assign(blocks: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """New shard of each part; blocks: (old shard, block, part) -> bytes."""
    total = sum(blocks.values())
    room = capacities_of(total, shards)
    sizes: dict[int, int] = defaultdict(int)
    whole: dict[tuple, list] = defaultdict(list)
    for key, size in blocks.items():
        sizes[key[0]] += size
        whole[key[:2]].append((size, key))
    owed = dict(transfers(sizes, room))
    out: dict[tuple, int] = {}
    # the largest block first, to the new shard that this old one owes most; where its room ends the block flows on into another
    for block, parts in sorted(whole.items(), key=lambda kv: (-sum(s for s, _ in kv[1]), kv[0])):
        left, to = sum(s for s, _ in parts), None
        for size, key in sorted(parts, key=lambda x: (-x[0], x[1])):
            if to is None or room[to] < size or owed.get((block[0], to), 0) < size:
                to = max(room, key=lambda n: (owed.get((block[0], n), 0) >= left, min(owed.get((block[0], n), 0), room[n]), n == block[0], room[n], -n))  # noqa: B023
            out[key] = to
            owed[(block[0], to)] = owed.get((block[0], to), 0) - size
            room[to] -= size
            left -= size
    # single blocks from the fullest shard to the emptiest while that evens them
    held = defaultdict(list)
    for key, to in out.items():
        held[to].append((blocks[key], key))
    for _ in range(64 * shards):
        low, high = max(room, key=room.get), min(room, key=room.get)
        gap = room[low] - room[high]
        fit = [x for x in held[high] if 0 < x[0] < gap]
        if not fit:
            break
        x = min(fit, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove(x)
        held[low].append(x)
        out[x[1]] = low
        room[low], room[high] = room[low] - x[0], room[high] + x[0]
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, text: str = "text") -> DataFrame:
    """docs: doc_id, text and any other columns; old_shard: int from 0. Returns doc_id, size, text_crc32, old_shard, shard
    and slot. An empty table gives an empty one."""
    spark = docs.sparkSession
    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(5)), F.lit(BLOCKS)).cast("int").alias("block"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart; fixed by the table written next
    )
    rows = cut(rows, "sizes").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    cells = {(r.old_shard, r.block, r.part): (r.size, r.n) for r in rows.groupBy("old_shard", "block", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    placed = assign({k: v[0] for k, v in cells.items()}, shards)
    first: dict[int, int] = defaultdict(int)
    plan = []
    for key in sorted(placed):
        plan.append((*key, placed[key], first[placed[key]]))
        first[placed[key]] += cells[key][1]
    # at most old shards * BLOCKS * PARTS rows, whatever the input
    plan = spark.createDataFrame(plan, "old_shard int, block int, part int, shard int, first long")
    own = Window.partitionBy("old_shard", "block", "part").orderBy("doc_id", "text_crc32", "row")
    numbered = rows.withColumn("nth", F.row_number().over(own)).join(F.broadcast(plan), ["old_shard", "block", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def moved(assignment: DataFrame, shards: int = 8) -> dict[str, int]:
    """Of reshard()'s result: all bytes, those whose shard changes, and the fewest that any even layout changes."""
    rows = assignment.groupBy("old_shard").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("shard") != F.col("old_shard"), F.col("size")).otherwise(0)).alias("moved")).collect()
    return {"bytes": sum(r.size for r in rows), "moved": sum(r.moved for r in rows), "least": least_moved({(r.old_shard,): r.size for r in rows}, shards)}


def rewrite(docs: DataFrame, assignment: DataFrame, path: str, text: str = "text") -> None:
    """Write the files of the shards that change, each whole, in place of the folders of these shards under path; others stay.
    assignment is reshard()'s result of docs; shard and slot replace columns of docs so called.

    Rows are met by doc_id (null too), size and hash of the text, and their number among rows that agree in these. Such rows
    may differ elsewhere, so if they lie in several shards, all of those are written. The files are made in a staging folder
    first, so docs may be read from path; old folders are kept in it until all new ones are in place."""
    spark = docs.sparkSession
    own = ["doc_id", "size", "text_crc32"]
    both = F.array("old_shard", "shard")
    moved = assignment.where("shard <> old_shard").select(F.explode(both).alias("shard"))
    alike = assignment.groupBy(*own).agg(F.flatten(F.collect_set(both)).alias("shards"), F.count_distinct("old_shard", "shard").alias("n")).where("n > 1")
    touched = sorted(r.shard for r in moved.union(alike.select(F.explode("shards"))).distinct().collect())
    if not touched:
        return
    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    keyed = docs.drop("shard", "slot").withColumns({"_size": (F.octet_length(data) + 1).cast("long"), "_crc": F.crc32(data)})
    whole = F.xxhash64(*(f.name for f in keyed.schema.fields if "map<" not in f.dataType.simpleString()))  # the same order in a task run again
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_size", "_crc").orderBy(whole)))
    rows = assignment.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("shard", "slot")))
    rows = rows.where(F.col("shard").isin(touched)).select(F.col("doc_id").alias("_id"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "_n", "shard", "slot")
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c")) & (F.col("_nth") == F.col("_n"))
    joined = keyed.join(rows, met).drop("_size", "_crc", "_nth", "_id", "_s", "_c", "_n")

    Path = spark._jvm.org.apache.hadoop.fs.Path
    stage = f"{path.rstrip('/')}/.rewrite-{uuid.uuid4().hex}"  # readers skip names with a dot
    files = Path(stage).getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(a: str, b: str) -> None:
        if not files.rename(Path(a), Path(b)):
            raise OSError(f"can't move {a} to {b}; the old files are in {stage}/old")

    try:
        joined.write.partitionBy("shard").parquet(f"{stage}/new")
    except Exception:
        files.delete(Path(stage), True)
        raise
    files.mkdirs(Path(f"{stage}/old"))
    for name in (f"shard={n}" for n in touched):
        if files.exists(Path(f"{path}/{name}")):
            rename(f"{path}/{name}", f"{stage}/old/{name}")
        if files.exists(Path(f"{stage}/new/{name}")):
            rename(f"{stage}/new/{name}", f"{path}/{name}")
    files.delete(Path(stage), True)
    spark.catalog.refreshByPath(path)

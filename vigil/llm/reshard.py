"""Resharding that moves the fewest bytes: a minimum-cost flow from old shards to new capacities.

Rows are gathered in blocks: (old shard, power of two of the size, one of ``PARTS`` by hash). The driver gets one row per block, so their
number is bounded by shards * 64 * ``PARTS``, whatever the number of documents. Old shard i supplies its bytes, new shard j takes its
capacity (equal parts of the whole); a byte costs 0 where i = j and 1 elsewhere. The flow of least cost says how many bytes go from
where to where; blocks fill these amounts, large ones first, and small ones even out what is left. Rows then follow their
blocks, and the files of the shards whose rows change are written.

Size is the UTF-8 length of the text plus 1. Shards that have the same number in the old layout and the new one are the same. Defined
cases: a null text has size 1 and CRC 0; an old shard that is null or not among the new ones (its shard is given up) moves
as a whole; equal rows are told apart only by their slots; a null id stays null; an empty table gives empty shards; further columns are
ignored by the query, and carried by ``write_shards``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.llm.registry import query
from vigil.streaming.storage import new_folder

SHARDS = 16
PARTS = 64
#: Rows of one shard are numbered in so many groups.
GROUPS = 64
#: Blocks moved to even out what the flow leaves, at most.
TOUCHES = 5_000

ADDED = ["__size", "__crc", "__old", "__shard", "__slot", "__power", "__part", "__group", "__before", "__o", "__p", "__q"]


def cheapest_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts from sources to sinks (equal sums) of least total cost, by augmenting along cheapest paths."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    price: dict[tuple[int, int], int] = {}
    near: dict[int, set[int]] = defaultdict(set)

    def edge(a: int, b: int, most: int, c: int) -> None:
        room[a, b], room[b, a], price[a, b], price[b, a] = most, 0, c, -c
        near[a].add(b)
        near[b].add(a)

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, sum(supply), cost(i, j))
    for j, x in enumerate(demand):
        edge(n + j, sink, x, 0)
    while True:
        far, back = {source: 0}, {}
        queue = [source]
        while queue:
            a = queue.pop(0)
            for b in near[a]:
                if room[a, b] > 0 and far[a] + price[a, b] < far.get(b, 1 << 60):
                    far[b], back[b] = far[a] + price[a, b], a
                    queue.append(b)
        if sink not in far:
            break
        path = [sink]
        while path[-1] != source:
            path.append(back[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        amount = min(room[s] for s in steps)
        for a, b in steps:
            room[a, b] -= amount
            room[b, a] += amount
    return {(i, j): room[n + j, i] for i in range(n) for j in range(m) if room[n + j, i]}


def transfers(blocks: list[tuple[tuple, int | None, int]], shards: int) -> dict[tuple, int]:
    """New shard of each block. ``blocks``: (name, old shard, bytes)."""
    olds = sorted({old for _, old, _ in blocks}, key=str)
    supply = [sum(size for _, old, size in blocks if old == o) for o in olds]
    total = sum(supply)
    demand = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = cheapest_flow(supply, demand, lambda i, j: int(olds[i] != j))
    to, load = {}, [0] * shards
    for i, old in enumerate(olds):
        # what stays comes last: large blocks leave first, and what doesn't fit any amount stays
        open_ = {j: x for (k, j), x in flow.items() if k == i and j != old}
        stays = flow.get((i, old), 0) if old in range(shards) else None
        for name, _, size in sorted((b for b in blocks if b[1] == old), key=lambda b: (-b[2], str(b[0]))):
            j = max(open_, key=lambda j: (open_[j], -j), default=None)
            if stays is not None and stays >= size and (j is None or stays >= open_[j]):
                stays -= size
                j = old
            elif j is not None and (open_[j] >= size or stays is None):
                open_[j] -= size
            else:
                j = old if stays is not None else min(range(shards), key=load.__getitem__)
                stays = stays - size if stays is not None else None
            to[name] = j
            load[j] += size
    own = defaultdict(dict)
    for name, _, size in blocks:
        own[to[name]][name] = size
    for _ in range(TOUCHES):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        name = min((x for x in own[high] if 0 < own[high][x] < gap), key=lambda x: (abs(2 * own[high][x] - gap), str(x)), default=None)
        if name is None or gap <= 1:
            break
        size = own[high].pop(name)
        own[low][name] = size
        to[name], load[high], load[low] = low, load[high] - size, load[low] + size
    return to


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``__size``, ``__crc``, ``__old`` and new ``__shard`` and ``__slot``; columns of these names are replaced."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        *[c for c in docs.columns if c not in ADDED], (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("__size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("__crc"), old.cast("int").alias("__old"),
    )
    spot = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "__crc")
    rows = rows.withColumn("__power", F.floor(F.log2("__size")).cast("int")).withColumn("__part", F.pmod(spot, F.lit(PARTS)).cast("int"))
    keys = ["__old", "__power", "__part"]
    sizes = rows.groupBy(*keys).agg(F.sum("__size").alias("bytes")).collect()  # one row per block
    to = transfers([((r["__old"], r["__power"], r["__part"]), r["__old"], r["bytes"]) for r in sizes], shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(*k, j) for k, j in to.items()], "__o int, __p int, __q int, __shard int")
    same = F.col("__old").eqNullSafe(F.col("__o")) & (F.col("__power") == F.col("__p")) & (F.col("__part") == F.col("__q"))
    # the plan has a row per block, which are bounded as said above
    placed = rows.join(F.broadcast(plan), same).drop("__o", "__p", "__q", "__power", "__part")
    group = F.pmod(F.shiftright(spot, 8), F.lit(GROUPS)).cast("int")
    return numbered(placed.withColumn("__group", group))


def numbered(rows: DataFrame) -> DataFrame:
    """``__slot``: gapless from 0 in each ``__shard``. Groups are numbered apart, behind the sizes of the groups before them."""
    counts = rows.groupBy("__shard", "__group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shard", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__shard", "__group").orderBy("doc_id", "__crc")
    own = rows.withColumn("__slot", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["__shard", "__group"])
    return own.withColumn("__slot", F.col("__slot") + F.col("__before")).drop("__before", "__group")


def write_shards(rows: DataFrame, path: str) -> None:
    """The files of all shards whose rows change: of a new shard that gets or loses any row. A folder per shard."""
    moved = rows.where(~F.col("__old").eqNullSafe(F.col("__shard")))
    changed = moved.select(F.explode(F.array("__old", "__shard")).alias("s")).where("s is not null").distinct()
    rows.join(F.broadcast(changed), F.col("__shard") == F.col("s"), "left_semi").write.partitionBy("__shard").parquet(path)


@query("op8_flow_reshard")
def flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by source before, in 16 shards of near equal bytes after: read back from the written files."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    rows = resharded(docs.select("doc_id", "text", "source"), old)
    path = new_folder(spark, "shards")
    # every shard gets rows here or loses some, so all files are written
    rows.write.partitionBy("__shard").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.select(
        "doc_id", F.col("__size").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__old").alias("old_shard"),
    )

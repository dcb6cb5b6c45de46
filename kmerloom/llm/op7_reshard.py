"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of given capacities.

The flow between shards is solved on the driver from one number per shard. Within an old shard documents are laid out
from the largest to the smallest; the first bytes stay, the next ones go where the flow sends them, so that the cuts
between destinations fall among the smallest documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import cut, ranked, remove_path, shared_folder, table

SUB_BLOCKS = 256
#: Shards of either kind at most: the flow between them is solved on the driver.
SHARDS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Bytes from each old shard to each new one that move all supply at the least total cost(old, new) per byte.

    Successive shortest paths (Bellman-Ford, for residual costs below zero) on source -> old -> new -> sink.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards don't hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    c = cost(i, j)
                    if far[i] + c < far[n + j]:
                        far[n + j], back[n + j], changed = far[i] + c, i, True
                    if flow[i][j] and far[n + j] - c < far[i]:
                        far[i], back[i], changed = far[n + j] - c, n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
        path, at = [n + end], n + end
        while (at := back[at]) is not None:
            path.append(at)
        path.reverse()
        most = min(left[path[0]], room[end], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n))
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        room[end] -= most
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old: F.Column, shards: int = 16, capacities: list[int] | None = None, key: F.Column | None = None) -> DataFrame:
    """A shard and a slot for each row of docs(doc_id, text, ...): (doc_id, size, text_crc32, old_shard, shard, slot).

    With a `key`, which names a row alike each time docs are read, the result has it too, as row_key.

    size is the text's UTF-8 bytes plus 1. `old` tells each row's shard so far, from 0; a null one counts as 0. New
    shard j is the old shard j where there was one, and takes `capacities[j]` bytes, by default equal shares; a
    document that lies across a cut goes to the side that holds its middle. Slots are gapless from 0.

    A null text has no bytes, size 1 and checksum 0. Null, repeated and equal ids are placed row by row; equal rows may
    get different places. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old, F.lit(0)).cast("int").alias("old_shard"),
        *([key.alias("row_key")] if key is not None else []),
    )
    base = cut(base.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")))
    sizes = {r["old_shard"]: r["s"] for r in base.groupBy("old_shard").agg(F.sum("size").alias("s")).limit(SHARDS + 1).collect()}
    if max(len(sizes), max(sizes, default=0), shards) > SHARDS or min(sizes, default=0) < 0:
        raise ValueError(f"shards are numbered from 0 to {SHARDS} at most")
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    # staying is free; what moves costs its bytes
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards), lambda i, j: int(i != j))
    spans = []
    for i, row in enumerate(flow):
        upper = 0
        steps = []
        for j in sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j != i, j)):
            upper += row[j]
            steps.append((float(upper), j))
        if steps:
            spans.append((i, [(float("inf") if k + 1 == len(steps) else u, j) for k, (u, j) in enumerate(steps)]))
    spark = docs.sparkSession
    # as many rows as there are old shards
    table_of = F.broadcast(spark.createDataFrame(spans, "old_shard int, steps array<struct<upper:double,shard:int>>"))
    large_first = (64 - F.length(F.bin("size"))).cast("int") * SUB_BLOCKS
    block = large_first + F.pmod(F.col("h"), F.lit(SUB_BLOCKS)).cast("int")
    laid = ranked(base, ["old_shard"], block, ["h", "doc_id", "text_crc32"], "size").drop("rank")
    middle = F.col("before") + F.col("size") / 2
    put = laid.join(table_of, "old_shard").withColumn("shard", F.filter("steps", lambda x: x["upper"] > middle)[0]["shard"]).drop("steps")
    put = cut(put)
    slots = ranked(put, ["shard"], F.pmod(F.xxhash64("h"), F.lit(16 * SUB_BLOCKS)).cast("int"), ["h", "doc_id", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("rank").cast("long").alias("slot"), *(["row_key"] if key is not None else []))


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Replace the files of the shards that gain or lose rows, path/shard=N; returns their numbers, at most one per shard.

    docs and placed are joined by row_key, so null and repeated ids are written row by row; columns of docs named shard or
    slot are replaced. The new files are first written whole to a folder of their own, then each affected shard's folder
    is exchanged; the folders of other shards are not touched. docs may be read from path, but not after.
    """
    if "row_key" not in docs.columns or "row_key" not in placed.columns:
        raise ValueError("rows are known by their row_key")
    moved = placed.filter("old_shard <> shard")
    affected = sorted({r[0] for r in moved.select("old_shard").union(moved.select("shard")).distinct().collect()})
    target = docs.drop("shard", "slot").join(placed.filter(F.col("shard").isin(affected)).select("row_key", "shard", "slot"), "row_key")
    new = f"{path}/_new-{uuid.uuid4().hex}"
    # a task writes a file for each shard that its rows go to, so that texts move once
    target.drop("row_key").write.partitionBy("shard").parquet(new)
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for i in affected:
        old, made = hadoop.Path(f"{path}/shard={i}"), hadoop.Path(f"{new}/shard={i}")
        files.delete(old, True)
        if files.exists(made) and not files.rename(made, old):  # a shard that lost all its rows has no new files
            raise OSError(f"shard {i} is still in {new}")
    remove_path(spark, new)
    return affected


def resharded(docs: DataFrame, old: F.Column, shards: int, path: str) -> DataFrame:
    """reshard, with the affected shards written under path and their rows' size and text_crc32 read from there.

    docs has a row_key, which names a row alike each time docs are read, so null and repeated ids are written row by
    row. Rows of shards that nothing enters or leaves are as they were.
    """
    placed = cut(reshard(docs, old, shards, key=F.col("row_key")))
    affected = rewrite(docs.withColumn("old_shard", F.coalesce(old, F.lit(0)).cast("int")), placed, path)
    same = placed.filter(~F.col("shard").isin(affected)).drop("row_key")
    if not affected:
        return same
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    written = docs.sparkSession.read.parquet(path).select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "old_shard", F.col("shard").cast("int"), "slot"
    ).filter(F.col("shard").isin(affected))
    return same.select(*written.columns).union(written)


def op7_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout has twelve shards by source, so a hot source makes one far too large."""
    docs = table(spark, sf_dir, "documents").withColumn("row_key", F.struct("_metadata.file_path", "_metadata.row_index"))
    old = F.crc32(F.col("source").cast("binary")) % 12
    found = resharded(docs, old, 16, f"{shared_folder(spark)}/reshard-{uuid.uuid4().hex}")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")

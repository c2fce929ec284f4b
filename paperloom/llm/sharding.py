"""Sharding over fixed virtual slots (DataFrame functions only).

Records hash into ``slots`` virtual slots; a versioned map says which shard holds a slot. Rebalancing sums bytes per
slot and edits the map: only the slots that it moves change their shard. The map has a row per slot, never per record,
so it is held and edited on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.text import bring_back, set_aside
from paperloom.session import written

SLOTS = 4096
#: The setting that names the stored map of the registered queries; without it each run starts from a new one.
MAP_SETTING = "spark.paperloom.shard.map"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: shard_of[slot]."""

    version: int
    shard_of: tuple[int, ...]
    shards: int

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(0, tuple(slot % shards for slot in range(slots)), shards)

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that narrows the gap between them."""
        shard_of = list(self.shard_of)
        held: list[dict[int, int]] = [{} for _ in range(self.shards)]
        for slot, size in sizes.items():
            if size:
                held[shard_of[slot]][slot] = size
        load = [sum(x.values()) for x in held]
        for _ in range(4 * len(shard_of)):
            full, free = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[full] - load[free]
            fitting = [(abs(gap - 2 * size), slot) for slot, size in held[full].items() if size < gap]
            if not fitting:
                break
            slot = min(fitting)[1]
            size = held[free][slot] = held[full].pop(slot)
            load[full], load[free], shard_of[slot] = load[full] - size, load[free] + size, free
        return SlotMap(self.version + 1, tuple(shard_of), self.shards)

    def grown(self, sizes: dict[int, int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest shards; no other slot moves."""
        shard_of, new = list(self.shard_of), self.shards
        load = [0] * (new + 1)
        for slot, size in sizes.items():
            load[shard_of[slot]] += size
        goal = sum(load) / (new + 1)
        for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
            if load[new] + sizes[slot] <= goal and load[shard_of[slot]] - sizes[slot] >= goal - sizes[slot]:
                load[shard_of[slot]] -= sizes[slot]
                load[new] += sizes[slot]
                shard_of[slot] = new
        return SlotMap(self.version + 1, tuple(shard_of), new + 1)

    def moved(self, older: SlotMap) -> list[int]:
        return [s for s, (a, b) in enumerate(zip(older.shard_of, self.shard_of, strict=True)) if a != b]

    def shard(self, slot: Column) -> Column:
        return F.element_at(F.lit(list(self.shard_of)).cast("array<int>"), slot + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table (version, slot, shard) at ``path``."""
        table = spark.range(len(self.shard_of)).select(F.lit(self.version).alias("version"), F.col("id").cast("int").alias("slot"), self.shard(F.col("id").cast("int")).alias("shard"), F.lit(self.shards).alias("shards"))
        table.coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, or the latest."""
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.where(F.col("version") == version).orderBy("slot").collect()
        return SlotMap(version, tuple(r["shard"] for r in rows), rows[0]["shards"])


def stored_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The latest version at ``path``, if there is one."""
    try:
        return SlotMap.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def next_map(older: SlotMap | None, sizes: dict[int, int], shards: int, slots: int) -> SlotMap:
    """The version after ``older`` (or after the initial one): grown to ``shards``, then rebalanced."""
    placed = older or SlotMap.initial(shards, slots)
    if len(placed.shard_of) != slots or placed.shards > shards:
        raise ValueError(f"the stored map has {placed.shards} shards of {len(placed.shard_of)} slots: neither can be made {shards} of {slots}")
    whole = {s: sizes.get(s, 0) for s in range(slots)}
    while placed.shards < shards:
        placed = placed.grown(whole)
    return placed.rebalanced(sizes)


def slot_sizes(sized: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot: at most as many rows as there are slots."""
    return {r["vslot"]: r["bytes"] for r in sized.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _slotted(docs: DataFrame, slots: int, copies: DataFrame | None = None) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``docs`` with size, text hash and virtual slot, and (bytes, rows) of each slot; rows among ``copies`` are dealt one by one."""
    sized = docs.withColumns({"size": text_size(), "_hash": F.xxhash64("text"), "_copy": F.lit(None).cast("long")})
    if copies is not None:
        sized = _numbered(sized, copies)
    # A null adds nothing to a hash.
    sized = sized.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "_hash", "_copy"), F.lit(slots)).cast("int"))
    rows = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return sized, {r["vslot"]: (r["bytes"], r["n"]) for r in rows}


def _numbered(sized: DataFrame, copies: DataFrame, parts: int = 1024) -> DataFrame:
    """Rows among ``copies`` get numbers from 1 as ``_copy``: within parts of a row's copies, then by the parts' sums.

    Copies don't differ, so it doesn't matter which has which number: the rows are the same however the input lies.
    """
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_same"))
    # The place tells copies apart; they come from a written table, where it is the same whenever it is read.
    marked = sized.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(copies), same, "left")
    many = marked.where("_many").withColumn("_part", F.pmod("_place", F.lit(parts)))
    by = Window.partitionBy("_doc", "_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = many.groupBy("_doc", "_same", "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(by), F.lit(0))).select(F.col("_doc").alias("_d"), F.col("_same").alias("_s"), F.col("_part").alias("_p"), "_before")
    nth = F.row_number().over(Window.partitionBy("_doc", "_same", "_part").orderBy("_place"))
    met = many.withColumn("_nth", nth).join(before, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_same") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return marked.where("_many is null").select(sized.columns).unionByName(met.withColumn("_copy", F.col("_before") + F.col("_nth")).select(sized.columns))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` with size, vslot, shard, slot (a record's place in its shard, gapless from 0) and map_version.

    Shards have nearly equal bytes. The virtual slot depends on doc_id and text, so equal ids with unlike texts go
    apart; a null doc_id or text hashes like any other value. Copies of one row (same doc_id and text) share a slot,
    unless they are more than a slot's even share of the rows: then they are dealt over all slots. Places are numbered
    by doc_id, then text hash, within a virtual slot, after the rows of the shard's earlier virtual slots: no task holds
    a whole shard. Clashing column names are replaced; an empty table gives an empty result. Texts are hashed whole.

    ``map_path``: the latest map stored there is edited, and the next version stored, after the rows have been written;
    only slots that the edit moves change their shard. A stored map may gain shards, but not lose any. One run at a time
    may use a path. Without it, or at a path without a map, the edit is of the initial map.
    """
    new = ["size", "vslot", "shard", "slot", "map_version"]
    docs, names = set_aside(docs, ["doc_id", "text"], new)
    sized, counted = _slotted(docs, slots)
    total = sum(n for _, n in counted.values())
    full = [s for s, (_, n) in counted.items() if n * slots > 2 * total and n > 1]
    if full:
        # A row with more copies than a slot's even share lies in such a slot; there are fewer of them than slots.
        copies = sized.where(F.col("vslot").isin(full)).groupBy("doc_id", "_hash").agg(F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * slots > total))
        copies = written(copies.select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_same"), F.lit(True).alias("_many")), "copies")
        if copies.count():
            # Written, so that a row's place in its file, which tells its copies apart, is the same whenever it is read.
            sized, counted = _slotted(written(docs, "docs"), slots, copies)
    placed = next_map(stored_map(docs.sparkSession, map_path) if map_path else None, {s: b for s, (b, _) in counted.items()}, shards, slots)
    before, seen = [0] * slots, [0] * shards
    for slot in range(slots):
        before[slot] = seen[placed.shard_of[slot]]
        seen[placed.shard_of[slot]] += counted.get(slot, (0, 0))[1]
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "_hash")) - 1
    out = sized.withColumns({"shard": placed.shard(F.col("vslot")), "slot": F.element_at(F.lit(before).cast("array<long>"), F.col("vslot") + 1) + place, "map_version": F.lit(placed.version)})
    if map_path:
        out = written(out.select(*names, *new), "sharded")
        placed.save(docs.sparkSession, map_path)
    return bring_back(out, names, new)

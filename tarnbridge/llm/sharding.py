"""Op 3: sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node weighs as much as the shards below it. A node's draw
for a key is ``-ln(u) / weight``, u hashed from the key and the node's name: an exponential variable
whose rate is the weight. The walk goes from the root to the region, the rack in it and the shard in
that whose draw is least, so a shard is picked in proportion to its weight. Nodes draw
independently: a changed weight changes the draws on the path above it only, so rows move only in
the subtrees whose weights change. A shard that is added opens a region and a rack of its own; no
other node's weight changes, so rows move into it and nowhere else.

Nulls: a null key is hashed as the empty string, a null text has no bytes (size 1, CRC 0). Texts
of any length only give their size and CRC. Repeated rows fall into one shard and get a slot each;
ties in the order of slots are rows that are equal in id, size and CRC. Only doc_id and text are
read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, hex_int, table, unused

SHARDS = 16
RACKS_A_REGION = 2
SHARDS_A_RACK = 4
#: Slots are numbered within so many buckets a shard; their offsets are all that is broadcast.
SLOT_BUCKETS = 256

#: A node: its name, its weight and what is below it (nothing below a shard, whose name ends with its number).
Node = tuple[str, float, list]


def tree(weights: Sequence[float], racks_a_region: int = RACKS_A_REGION, shards_a_rack: int = SHARDS_A_RACK) -> list[Node]:
    """The regions of a tree over shards 0, 1, 2 and so on."""
    leaves = [(f"shard {i}", float(w), []) for i, w in enumerate(weights)]
    above = lambda name, nodes, each: [(f"{name} {i // each}", sum(n[1] for n in nodes[i : i + each]), nodes[i : i + each]) for i in range(0, len(nodes), each)]
    return above("region", above("rack", leaves, shards_a_rack), racks_a_region)


def with_shard(regions: list[Node], weight: float) -> list[Node]:
    """The tree with one more shard, in a region and a rack of its own."""
    racks = [rack for _, _, below in regions for rack in below]
    shards = sum(len(below) for _, _, below in racks)
    return [*regions, (f"region {len(regions)}", float(weight), [(f"rack {len(racks)}", float(weight), [(f"shard {shards}", float(weight), [])])])]


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of a node for a key, at the rate of the node's weight."""
    u = (hex_int(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, nodes: list[Node]) -> Column:
    """The least draw of some nodes and the place of that node: struct(draw, i)."""
    return F.array_min(F.array(*[F.struct(draw(key, name, weight).alias("draw"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(nodes)]))


def _named(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.transform(F.array(value), use).getItem(0)


def _below(key: Column, nodes: list[Node], i: Column) -> Column:
    """The shard that the walk comes to from node i; the nodes that aren't on the way don't draw."""
    down = [descend(key, below) if below else F.lit(int(name.split()[1])) for name, _, below in nodes]
    out = F.when(i == 0, down[0])
    for k, way in enumerate(down[1:], 1):
        out = out.when(i == k, way)
    return out


def descend(key: Column, nodes: list[Node]) -> Column:
    """The number of the shard that the walk from these nodes down comes to."""
    if len(nodes) == 1:
        return _below(key, nodes, F.lit(0))
    return _named(_least(key, nodes).getField("i"), lambda i: _below(key, nodes, i))


def place(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """Adds ``shard`` (tree of these weights) and ``grown_shard`` (one more shard).

    The grown tree differs by one region: its walk is the old one unless that region's draw is least.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    regions = tree(weights)
    name, weight, _ = with_shard(regions, grown_weight)[-1]
    old = _named(_least(text, regions), lambda m: F.struct(m["draw"].alias("draw"), _below(text, regions, m["i"]).alias("shard")))
    grown = lambda s: F.when(draw(text, name, weight) < s["draw"], F.lit(len(weights))).otherwise(s["shard"])
    both = _named(old, lambda s: F.struct(s["shard"].alias("shard"), grown(s).alias("grown_shard")))
    at = unused(docs, "at")
    return docs.withColumn(at, both).select(*docs.columns, f"{at}.shard", f"{at}.grown_shard")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """One row per document: shard, grown_shard and a gapless slot within the shard.

    The slot is a running number within hash buckets of a shard plus the bucket's offset, so no
    task has to hold a whole shard; a doc_id that many rows share is spread by the CRC of their texts.
    Texts are read once, for a narrow table that the slots are numbered from. The offsets, shards
    times ``buckets`` rows, are broadcast.
    """
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|slot|"), F.col("text_crc32").cast("string"))
    rows = checkpointed(place(narrow, weights=weights).withColumn("bucket", (hex_int(F.md5(key), 1, 8) % buckets).cast("int")))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("within", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("within") - 1).cast("bigint").alias("slot"), "grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _crc_row(n: int) -> int:
    for _ in range(8):
        n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
    return n


_PER_REGION = RACKS_A_REGION * SHARDS_A_RACK
_REGIONS = SHARDS // _PER_REGION


def _sql_draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || md5(k || '|{name}')[1:13])::BIGINT + 0.5) / {2**52}) / {weight}"


def _sql_draws(name: str, first: int, count: int, weight: int) -> str:
    return "[" + ", ".join(_sql_draw(f"{name} {i}", weight) for i in range(first, first + count)) + "]"


ORACLE = f"""
WITH t AS (
  SELECT {[_crc_row(n) for n in range(256)]}::BIGINT[] AS tab
), d AS (
  SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS k FROM documents
), c AS (
  SELECT *, xor(list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda a, b: (xor((a::BIGINT) >> 8, tab[(xor(a::BIGINT, ('0x' || b)::BIGINT) & 255) + 1]))::VARCHAR, '4294967295')::BIGINT, 4294967295) AS text_crc32 FROM d, t
), e AS (
  SELECT *, {_sql_draws('region', 0, _REGIONS, _PER_REGION)} AS regions, {_sql_draw(f'region {_REGIONS}', 1)} AS added,
    {_sql_draws('rack', 0, SHARDS // SHARDS_A_RACK, SHARDS_A_RACK)} AS racks, {_sql_draws('shard', 0, SHARDS, 1)} AS shards,
    ('0x' || md5(k || '|slot|' || text_crc32)[1:8])::BIGINT % {SLOT_BUCKETS} AS bucket FROM c
), r AS (
  SELECT *, list_position(regions, list_min(regions)) - 1 AS region FROM e
), a AS (
  SELECT *, racks[region * {RACKS_A_REGION} + 1:(region + 1) * {RACKS_A_REGION}] AS near FROM r
), b AS (
  SELECT *, region * {RACKS_A_REGION} + list_position(near, list_min(near)) - 1 AS rack FROM a
), f AS (
  SELECT *, shards[rack * {SHARDS_A_RACK} + 1:(rack + 1) * {SHARDS_A_RACK}] AS nearest FROM b
), s AS (
  SELECT *, (rack * {SHARDS_A_RACK} + list_position(nearest, list_min(nearest)) - 1)::INTEGER AS shard FROM f
)
SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1)::BIGINT AS slot,
  CASE WHEN added < list_min(regions) THEN {SHARDS} ELSE shard END::INTEGER AS grown_shard
FROM s
"""

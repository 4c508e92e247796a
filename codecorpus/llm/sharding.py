"""Operator 4: sharding by a k-d tree over document metadata.

The unit of placement is a group of equal texts, so copies share a shard. A
group that outweighs a whole shard cannot be placed as one and is split into
its documents; there are fewer such groups than shards. A unit is a point
with the coordinates source, language, size and smallest id. The tree starts
with all shards; a node with k of them cuts along its widest dimension at
the weighted quantile ``floor(k / 2) / k`` of the units' bytes, until each
leaf is one shard with its share of the bytes.

The weighted medians are exact up to one unit and distributed: a coordinate
is a 52-bit number (20 bits of value, 32 bits of hash to order ties), and all
nodes of a level find their cut together, 12 bits per pass, from histograms
aggregated before their shuffle. Only histograms (shards x 4096 rows) and
cuts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, ranked

DIMENSIONS = ("source", "lang", "size", "id")
_VALUE_BITS, _TIE_BITS, _DIGIT = 20, 32, 12
_BITS = _VALUE_BITS + _TIE_BITS + 8  # a multiple of the digit; the low 8 bits stay empty


def _unit_hash(c: Column) -> Column:
    """A value's hash as a number in [0, 1); null has one too."""
    return F.pmod(F.xxhash64(c, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def _coordinate(value: Column, key: Column, seed: int) -> Column:
    """``value`` in [0, 1] and a hash of the unit's key that orders ties."""
    top = F.least(F.lit((1 << _VALUE_BITS) - 1), F.floor(value * float((1 << _VALUE_BITS) - 1)))
    tie = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    return F.shiftleft(F.shiftleft(top.cast("long"), _TIE_BITS) + tie, 8)


def _node_column(cut: dict) -> Column:
    """Child number of each row's node after the level's cuts."""
    out = F.col("node")
    for node, (dim, at, left, right) in cut.items():
        out = F.when(F.col("node") == node, F.when(F.col(f"c{dim}") < at, left).otherwise(right)).otherwise(out)
    return out


def _cuts(units: DataFrame, nodes: dict[int, tuple[int, float, int]]) -> dict[int, tuple[int, int]]:
    """(dimension, cut) for every node {number: (dimension, bytes to the
    left, ..)}: the coordinate where the running bytes come nearest."""
    found: dict[int, tuple[int, int]] = {}
    todo = {n: (dim, want, 0, 0.0) for n, (dim, want, _) in nodes.items()}  # prefix, bytes before it
    for shift in range(_BITS - _DIGIT, -1, -_DIGIT):
        digit, inside = F.lit(None).cast("long"), F.lit(False)
        for n, (dim, _, prefix, _) in todo.items():
            c = F.col(f"c{dim}")
            here = (F.col("node") == n) & (F.shiftright(c, shift + _DIGIT) == prefix)
            digit = F.when(here, F.shiftright(c, shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))).otherwise(digit)
            inside = inside | here
        rows = (units.where(inside).groupBy("node", digit.alias("digit"))
                .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        by_node: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows:
            by_node.setdefault(r["node"], []).append((r["digit"], r["w"], r["n"]))
        rest = {}
        for n, (dim, want, prefix, before) in todo.items():
            at = float(before)
            bins = sorted(by_node.get(n, []))
            for i, (d, w, count) in enumerate(bins):
                if at + w < want and i < len(bins) - 1:
                    at += w
                    continue
                start = (prefix << _DIGIT) + d
                if count == 1 or shift == 0:  # the cut goes to the nearer side of one unit
                    found[n] = (dim, (start + (want - at > at + w - want)) << shift)
                else:
                    rest[n] = (dim, want, start, at)
                break
            else:
                found[n] = (dim, 0)
        todo = rest
        if not todo:
            break
    return found


def kd_shards(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 8), text_crc32,
    law ('bytes': sizes near equal), shard, slot (gapless from 0 in id
    order), grown_shard (null under this law).

    A null text counts as empty and shares its group; null ids, sources and
    languages are values like any other; repeated rows are placed each. An
    empty table gives no rows."""
    scratch = Scratch(documents.sparkSession, "shards")
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = scratch.save(
        columns(documents, doc_id=id_col, text=text_col, source=source_col, lang=lang_col)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                F.col("lang").cast("string").alias("lang"), (F.octet_length(body) + 8).cast("long").alias("size"),
                F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("print")), "docs")
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    groups = scratch.save(docs.groupBy("print").agg(
        F.sum("size").alias("w"), F.min("doc_id").alias("doc_id"), F.min("source").alias("source"),
        F.min("lang").alias("lang"), F.max("size").alias("size")), "groups")
    heavy = [r[0] for r in groups.where(F.col("w") > total[0] / shards).select("print").collect()]  # under `shards`
    split = F.col("print").isin([bytes(x) for x in heavy]) if heavy else F.lit(False)
    key = F.struct("print", F.when(split, F.xxhash64("doc_id")).otherwise(F.lit(0)).alias("member"))
    alone = docs.where(split).groupBy("print", "doc_id").agg(
        F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"),
        F.max("size").alias("size"))
    units = groups.where(~split).select("print", "doc_id", "w", "source", "lang", "size").unionByName(alone)
    low, high = total[1] or 0, total[2] or 0
    values = (_unit_hash(F.col("source")), _unit_hash(F.col("lang")),
              F.log1p(F.col("size").cast("double")) / F.log1p(F.lit(float(total[3] or 1))),
              F.coalesce((F.col("doc_id") - low) / float(max(1, high - low)), F.lit(0.0)))
    units = scratch.save(units.withColumn("unit", key).select(
        "unit", "w", *[_coordinate(v, F.col("unit"), i).alias(f"c{i}") for i, v in enumerate(values)],
        F.lit(0).alias("node")), "units-0")

    def stats() -> dict:
        """Bytes and spread of every dimension (value bits) per node."""
        spread = [F.shiftright(F.max(f"c{i}"), _TIE_BITS + 8) - F.shiftright(F.min(f"c{i}"), _TIE_BITS + 8)
                  for i in range(len(DIMENSIONS))]
        return {r["node"]: (r["w"], r["spread"])
                for r in units.groupBy("node").agg(F.sum("w").alias("w"), F.array(*spread).alias("spread")).collect()}

    leaves, number, level = {0: (0, shards)}, 0, 0  # leaves: node -> (first shard, number of shards)
    seen = stats()
    whole = seen[0][1] if seen else []
    while True:
        todo = {}
        for n, (_, k) in leaves.items():
            if k > 1 and n in seen:
                bytes_here, spread = seen[n]
                widest = max(range(len(DIMENSIONS)), key=lambda i: (spread[i] / max(1, whole[i]), -i))
                todo[n] = (widest, bytes_here * (k // 2) / k, k)
        if not todo:
            break
        cut, after = {}, {n: x for n, x in leaves.items() if x[1] == 1}
        for n, (dim, at) in _cuts(units, todo).items():
            first, k = leaves[n]
            cut[n] = (dim, at, number + 1, number + 2)
            after |= {number + 1: (first, k // 2), number + 2: (first + k // 2, k - k // 2)}
            number += 2
        leaves, level = after, level + 1  # written, or the levels' conditions would nest in one expression
        units = scratch.save(units.withColumn("node", _node_column(cut).cast("int")), f"units-{level}")
        scratch.drop(f"units-{level - 1}")
        seen = stats()
    shard = F.lit(0)
    for n, (first, _) in leaves.items():
        shard = F.when(F.col("node") == n, first).otherwise(shard)
    placed = units.select(F.col("unit.print").alias("_p"), F.col("unit.member").alias("_m"),
                          shard.cast("int").alias("shard"))
    member = F.when(split, F.xxhash64("doc_id")).otherwise(F.lit(0).cast("long"))
    rows = (docs.withColumn("_member", member)
            .join(placed, (F.col("print") == F.col("_p")) & (F.col("_member") == F.col("_m")))
            .select("doc_id", "size", "text_crc32", "shard"))
    return ranked(rows, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

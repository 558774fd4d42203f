"""Merkle manifest of a table: a root that binds every value of every row, and each row's own proof.

A row's leaf is the SHA-256 of its columns. Per group, leaves stand in the order of their id
and every ``fanout`` neighbours become one node, until one is left; the groups' roots
become one root in the same way.

Leaves lie in aligned blocks of ``fanout ** levels``, which are hashed where they lie.
Blocks then meet in a butterfly: in round r, the blocks whose numbers differ only in
their r-th digit (base ``fanout``) swap the roots of their subtrees. Each of them hashes the
common ancestor itself and keeps the others' roots as its proof, so after the last round
every block has its whole upper proof and nothing is sent down again. A last, incomplete
subtree has fewer blocks than its partners need; copies stand in for the missing ones.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import kept_table

FANOUT = 8
#: levels of a block: 8 ** 4 leaves
LEVELS = 4
PROOF = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 (hex) of the columns, each ``-`` if null, else its bytes' number, ``:`` and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _block_levels(leaves: list[str], whole: bool, fanout: int, levels: int) -> list[list[str]]:
    """A block's nodes from its leaves to its root. A block that is the ``whole`` tree ends at one node; else all have ``levels`` levels."""
    out = [leaves]
    while (len(out[-1]) > 1) if whole else len(out) <= levels:
        out.append(_parents(out[-1], fanout))
    return out


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a ``key``) and each row's ``place`` within its key by ``order``, and the key's ``total``.

    Ranges of (key, order) are sorted apart; a table of one row for each key and range gives their offsets.
    """
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = kept_table(ranged, "ordered").withColumn("__range", F.shiftright("__at", 33))
    ranges = ranged.groupBy("key", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("key").orderBy("__range")
    ranges = ranges.select("key", "__range", "__first", (F.sum("__n").over(before) - F.col("__n")).alias("__offset"), F.sum("__n").over(Window.partitionBy("key")).alias("total"))
    return ranged.join(ranges, ["key", "__range"]).withColumn("place", F.col("__at") - F.col("__first") + F.col("__offset")).drop("__at", "__range", "__first", "__offset")


def _round(nodes: DataFrame, number: int, fanout: int) -> DataFrame:
    """One exchange: nodes (key, at, open, digest, proof, copy) after partners have swapped their roots; open: how many nodes the level has."""
    step = fanout**number
    digit, above = F.expr(f"(at div {step}) % {fanout}"), F.expr(f"at div {step * fanout}")
    group = Window.partitionBy("key", above, F.col("at") % step)
    run = F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "digest")).over(group))  # fanout nodes at most
    met = nodes.withColumn("__digit", digit).withColumn("__run", run)
    side = lambda keep: F.array_join(F.transform(F.filter("__run", keep), lambda x: x["digest"]), "")
    level = F.struct(side(lambda x: x["digit"] < F.col("__digit")).alias("before"), side(lambda x: x["digit"] > F.col("__digit")).alias("after"))
    going = F.col("open") > 1
    met = met.select(
        "key", "at", "copy", "__digit", F.when(going, F.sha2(F.array_join("__run.digest", ""), 256)).otherwise(F.col("digest")).alias("digest"),
        F.when(going & ~F.col("copy"), F.concat("proof", F.array(level))).otherwise(F.col("proof")).alias("proof"),
        F.col("open").alias("__was"), F.expr(f"(open + {fanout - 1}) div {fanout}").alias("open"))
    missing = F.expr(f"{fanout - 1} - (__was - 1) % {fanout}")
    tail = (F.col("open") > 1) & (above == F.col("open") - 1) & (F.col("__digit") == 0) & (missing > 0)
    stand_ins = F.transform(F.sequence(F.lit(fanout) - missing, F.lit(fanout - 1)), lambda d: F.col("at") + d * step)
    places = F.when(tail, F.concat(F.array("at"), stand_ins)).otherwise(F.array("at"))
    spread = met.withColumn("__to", F.explode(places))
    own = F.col("__to") == F.col("at")
    return spread.select("key", F.col("__to").alias("at"), "open", "digest", F.when(own, F.col("proof")).otherwise(F.array().cast(PROOF)).alias("proof"), (F.col("copy") | ~own).alias("copy"))


def trees(rows: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` (key, leaf, others), each with its key's ``root`` and its ``proof``: an array of the siblings before and after it by level."""
    size = fanout**levels
    leaves = kept_table(placed(rows, order).withColumn("block", F.expr(f"place div {size}")), "leaves")

    def block_root(table: pa.Table) -> pa.Table:
        nodes = table.sort_by("place")
        whole = nodes["total"][0].as_py() <= size
        return pa.table({"key": nodes["key"].slice(0, 1), "at": nodes["block"].slice(0, 1), "open": pa.array([-(-nodes["total"][0].as_py() // size)], pa.int64()),
                         "digest": pa.array([_block_levels(nodes["leaf"].to_pylist(), whole, fanout, levels)[-1][0]])})

    roots = leaves.select("key", "place", "total", "block", "leaf").groupBy("key", "block").applyInArrow(block_root, "key string, at long, open long, digest string")
    nodes = roots.withColumn("proof", F.array().cast(PROOF)).withColumn("copy", F.lit(False))
    most, rounds = leaves.agg(F.max("total")).first()[0] or 0, 0
    while fanout**rounds * size < most:
        nodes = _round(nodes, rounds, fanout)
        rounds += 1
    uppers = nodes.where("not copy").select("key", F.col("at").alias("block"), F.col("digest").alias("root"), F.col("proof").alias("upper"))
    kept = [c for c in leaves.columns if c not in ("place", "total", "block")]
    schema = T.StructType([leaves.schema[c] for c in kept] + [T.StructField("root", T.StringType()), T.StructField("proof", PROOF)])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        table = left.sort_by("place")
        built = _block_levels(table["leaf"].to_pylist(), table["total"][0].as_py() <= size, fanout, levels)
        upper = [(p["before"], p["after"]) for p in right["upper"][0].as_py()]
        before, after = [], []
        for i in range(table.num_rows):
            for nodes_at in built[:-1]:
                start = i - i % fanout
                before.append("".join(nodes_at[start:i]))
                after.append("".join(nodes_at[i + 1 : start + fanout]))
                i //= fanout
            for b, a in upper:
                before.append(b)
                after.append(a)
        each = len(built) - 1 + len(upper)
        offsets = pa.array([each * i for i in range(table.num_rows + 1)], pa.int32())
        proof = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
        return pa.table([*(table[c] for c in kept), pa.array([right["root"][0].as_py()] * table.num_rows, pa.string()), proof], names=schema.names)

    return leaves.groupBy("key", "block").cogroup(uppers.groupBy("key", "block")).applyInArrow(prove, schema)


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", carried: dict[str, Column] | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, group, carried columns, leaf, subroot, root, proof) of each row.

    ``columns`` are bound by the leaf; ``carried`` are expressions over ``df`` that only travel along.
    proof: siblings before and after the row's path, level by level, from its leaf to the root.
    Within a group rows stand by id, a null id first, rows of one id by their leaf; groups
    stand by name, null first, by UTF-8 bytes. A null group is a group. Repeated rows are
    leaves of their own. An empty table gives none. Other columns are not read.
    """
    carried = carried or {}
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("key"),  # "-" sorts before "="
        F.col(id_col).alias("__id"), F.col(group_col).alias("__group"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        *(c.alias(f"__c{i}") for i, c in enumerate(carried.values())))
    inner = trees(kept_table(rows, "rows"), ["__id", "leaf", *(f"__c{i}" for i in range(len(carried)))], fanout, levels)
    inner = kept_table(inner, "proofs")
    tops = inner.groupBy("key").agg(F.min("root").alias("leaf"))
    outer = trees(tops.select(F.lit("").alias("key"), F.col("key").alias("__name"), "leaf"), ["__name"], fanout, levels)
    upper = outer.select(F.col("__name").alias("key"), F.col("root").alias("__root"), F.col("proof").alias("__upper"))
    return inner.join(kept_table(upper, "groups"), "key").select(
        F.col("__id").alias(id_col), F.col("__group").alias(group_col), *(F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)),
        "leaf", F.col("root").alias("subroot"), F.col("__root").alias("root"), F.concat("proof", "__upper").alias("proof"))

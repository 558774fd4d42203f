"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the bag of its 5-word shingles. Weights are split into the intervals [0,1),
[1,2), [2,4), ...; each (shingle, interval) runs a Poisson process at a rate of the
interval's length. A point lies at a hashed height and counts if that is below the
shingle's weight; it falls into one of the signature's places, which keeps the first.
Equal places then have the chance of the weighted Jaccard similarity.

Texts that share a band are candidates. Of each bucket one member, the leader, is compared
with all others, and links join classes. A bucket that still holds several classes is settled
across them: one with few such pairs pair by pair, another in blocks. A block is a chunk of
the members outside the bucket's largest class and a chunk of all members; it holds each bag
once, tests a pair in the first band that it shares, and only while its two are of different classes.
Before a pair's texts or bags are compared, their signatures must agree in as many places as a
link's almost surely do. Every comparison is exact on both whole bags.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evimap.llm.common import SMALL_SLICE, grams, kept_table, mix, window_starts, with_arrow, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: a bucket is settled pair by pair if that gives at most SMALL / 2 pairs for each member
SMALL = 8
#: shingles in a chunk of a block
CHUNK = 200_000
#: a link's signatures agree in fewer places than expected by over so many standard deviations with a chance below 1e-8
DEVIATIONS = 6.0


def bags(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, shingle hash, weight) of each distinct shingle; a shorter text is one shingle of all its words."""
    hashes, offsets = word_hashes(column)
    starts, rows = window_starts(offsets, shingle)
    values = grams(hashes, shingle)[starts] if len(starts) else np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    values = np.concatenate([values, np.array([grams(hashes[offsets[r] : offsets[r + 1]], int(sizes[r]), 77)[0] for r in short], np.uint64)])
    rows = np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], np.diff(np.append(at, len(rows))), len(sizes)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signature of each of ``n`` rows; rows without elements stay 0.

    Processes are followed up to a time at which a row's places are likely full; rows
    with an open place are done again up to a later time, so the result is exact.
    """
    total = np.bincount(rows, weights, n)
    until = size * (np.log(size) + 3) / np.maximum(total, 1)
    out = np.zeros((n, size), np.uint64)
    todo = total > 0
    while todo.any():
        of = todo[rows]
        parts = []
        row, value, weight, level = rows[of], values[of], weights[of], 0
        while len(row):
            length = float(2 ** max(level - 1, 0))
            key, r, w, x, step = mix(value + np.full(1, level + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row, weight, np.zeros(len(row)), 0
            low = 0.0 if level == 0 else length
            while len(key):
                step += 1
                draw = mix(key ^ mix(np.full(1, step, np.uint64)))
                x = x - np.log(_unit(draw)) / length
                on = x <= until[r]
                key, r, w, x, draw = key[on], r[on], w[on], x[on], draw[on]
                more = mix(draw + np.uint64(0xA0761D6478BD642F))
                below = low + _unit(more) * length < w  # one bit of the height a split of the interval
                slot = (mix(more) % np.uint64(size)).astype(np.int64)
                parts.append((r[below] * size + slot[below], x[below], draw[below]))
            level += 1
            on = weight > 2 ** (level - 1)
            row, value, weight = row[on], value[on], weight[on]
        place, time, point = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((time, place))
        place, point = place[order], point[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        full = np.bincount(place[first] // size, minlength=n) == size
        flat = np.zeros(n * size, np.uint64)
        flat[place[first]] = point[first]
        done = todo & full
        out[done] = flat.reshape(n, size)[done]
        todo &= ~full
        until = np.where(todo, until * 2, until)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash of each band of each row, the band's number mixed in."""
    n, size = signature.shape
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(size // bands):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(n, bands, -1)[:, :, i])
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (a.total() + b.total() - common) if common else 0.0


def bag(text: str, shingle: int = SHINGLE) -> Counter:
    words = (text or "").encode().split()
    if 0 < len(words) < shingle:
        return Counter([tuple(words)])
    return Counter(zip(*[words[i:] for i in range(shingle)], strict=False))


def elements(rows: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each occurrence: bags become sets whose Jaccard similarity is the bags' weighted one."""
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.repeat(rows, weights), mix(np.repeat(values, weights) + mix(nth.astype(np.uint64)))


def least_places(least: float, size: int) -> int:
    """Places in which two signatures agree if their bags have a similarity of ``least``, less DEVIATIONS."""
    return max(0, int(np.floor(size * least - DEVIATIONS * np.sqrt(size * least * (1 - least)))))


def _signed(df: DataFrame, id_col: str, text: str, bands: int, rows: int, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column("__body")
        row, value, weight, n = bags(column, shingle)
        total = np.bincount(row, weight, n).astype(np.int64)
        signature = signatures(row, value, weight, n, bands * rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(band_hashes(signature, bands).view(np.int64).ravel()))
        short = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands * rows, pa.int32()), pa.array(signature.astype(np.uint16).view(np.int16).ravel()))
        return [pa.array([hashlib.sha256(b" ".join(x.encode().split())).hexdigest() if x else "" for x in column.to_pylist()]), pa.array(total), lists, short]

    added = [T.StructField("sha", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.ShortType()))]
    return with_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("__body")), ["id", "__body"], added, run, dropped=("__body",), most=SMALL_SLICE)


def likely(pairs: DataFrame, signed: DataFrame, least: float, size: int) -> DataFrame:
    """Those ``pairs`` (a, b, ..) whose signatures agree in enough places."""
    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("places").alias("__a")), "a").join(signed.select(F.col("id").alias("b"), F.col("places").alias("__b")), "b")
    equal = F.size(F.filter(F.zip_with("__a", "__b", lambda x, y: x == y), lambda x: x))
    return both.where(equal >= least_places(least, size)).drop("__a", "__b")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Links (a, b) of the classes of those ``pairs`` (a, b, class_a, class_b) whose bags have a similarity of ``least`` or more.

    a's bag is kept while it stays the same.
    """
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("text_b")), "b")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        last, of_last, out = None, Counter(), []
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last:
                last, of_last = a, bag(a, shingle)
            out.append(similarity(of_last, bag(b, shingle)) >= least - 1e-12)
        return [pa.array(out, pa.bool_())]

    judged = with_arrow(both, ["class_a", "class_b", "text_a", "text_b"], [T.StructField("linked", T.BooleanType())], run, dropped=("text_a", "text_b"), most=SMALL_SLICE)
    return judged.where("linked").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _likely(weight: str, other: str, least: float) -> Column:
    """Whether two bags of these sizes can be similar enough."""
    return F.least(weight, other) >= F.greatest(weight, other) * (least - 1e-12)


def _led(live: DataFrame, least: float) -> DataFrame:
    """Each bucket's leader with its members of other classes."""
    return live.where((F.col("class") != F.col("leader.class")) & _likely("weight", "leader.weight", least)).select(
        F.col("leader.id").alias("a"), F.col("id").alias("b"), F.col("leader.class").alias("class_a"), F.col("class").alias("class_b"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets of several classes: their size, largest class, a leader by a hash, and whether pairs across classes are few for the size."""
    one = F.struct(F.xxhash64("id").alias("h"), "id", "class", "weight")
    of_class = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("shingles"), F.min(one).alias("leader"))
    found = of_class.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("shingles").alias("shingles"),
        F.max(F.struct("n", "class", "shingles")).alias("main"), F.min("leader").alias("leader")).where("classes > 1")
    few = F.col("size") * F.col("size") - F.col("squares") <= SMALL * F.col("size")
    return found.select("bucket", F.col("main.class").alias("main"), "shingles", (F.col("shingles") - F.col("main.shingles")).alias("outside"), "leader", few.alias("few"))


def _crossed(live: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members that are of different classes, if their sizes allow a link.

    One of the two is outside the largest class, so no pair within that class is ever looked at:
    the join reads at most twice as many pairs as there are across classes.
    """
    one = live.where("class <> main").select("bucket", F.col("id").alias("a"), F.col("class").alias("class_a"), F.col("weight").alias("weight_a"))
    other = live.select("bucket", F.col("id").alias("b"), F.col("class").alias("class_b"), F.col("weight").alias("weight_b"), "main")
    met = one.join(other, "bucket").where((F.col("class_a") != F.col("class_b")) & ((F.col("class_b") == F.col("main")) | (F.col("a") < F.col("b"))) & _likely("weight_a", "weight_b", least))
    swap = F.col("a") > F.col("b")
    return met.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("class_a", "class_b"), ("class_b", "class_a"))))


def _settle(table: pa.Table, least: float, enough: int) -> list[tuple]:
    """Links that join the classes of a block's two sides, each pair tested exactly in its first common band."""
    side, classes = table["side"].to_numpy(), table["class"].to_pylist()
    one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(one) or not len(other):
        return []
    numbers: dict[str, int] = {}  # a class may be a struct
    group = np.array([numbers.setdefault(repr(c), len(numbers)) for c in classes])
    names = list({repr(c): c for c in classes}.values())
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    weight = table["weight"].to_numpy().astype(np.float64)
    flat = lambda c: (x := table[c].combine_chunks()).flatten().to_numpy().reshape(len(x), -1)
    places, bands, band = flat("places"), flat("bands"), table["band"][0].as_py()
    lists = table["elements"].combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    out = []
    for a in one:
        b = other[(group[other] != group[a]) & (np.minimum(weight[other], weight[a]) >= np.maximum(weight[other], weight[a]) * (least - 1e-12))]
        b = b[(places[b] == places[a]).sum(1) >= enough]
        same = bands[b] == bands[a]
        b = b[bands[a][same.argmax(1)] == band] if len(b) else b
        mine = values[at[a] : at[a + 1]]
        for x in b:
            if root(group[a]) != root(group[x]):
                its = values[at[x] : at[x + 1]]
                common = int((mine[np.minimum(np.searchsorted(mine, its), len(mine) - 1)] == its).sum())
                if common / (len(mine) + len(its) - common) >= least - 1e-12:
                    parent[root(group[x])] = root(group[a])
                    out.append((names[group[a]], names[group[x]]))
    return out


def _half(hash64: Column) -> Column:
    """The lower 32 bits: two of a pair's 32 bands that differ have equal ones with a chance of 1e-8."""
    return F.shiftright(F.shiftleft(hash64, 32), 32).cast("int")


def _in_blocks(live: DataFrame, copies: DataFrame, texts: DataFrame, least: float, enough: int, shingle: int) -> DataFrame:
    """Links (a, b) of classes across the classes of open buckets; a block holds about 2 CHUNK shingles, two members at least.

    Members outside the largest class go to all chunks of the bucket, each member to all chunks of those outside.
    """
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        row, value, weight, n = bags(batch.column("body"), shingle)
        rows, numbers = elements(row, value, weight)
        numbers = numbers.view(np.int64)
        order = np.lexsort((numbers, rows))
        return [pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(n + 1)), pa.int32()), pa.array(numbers[order]))]

    members = live.select("id").distinct()
    held = with_arrow(texts.join(members, "id", "left_semi"), ["id", "body"], [T.StructField("elements", T.ArrayType(T.LongType()))], run, dropped=("body",), most=SMALL_SLICE)
    held = kept_table(held.join(copies.select(F.col("first").alias("id"), F.transform("of.bands", _half).alias("bands"), "of.places"), "id"), "bags")
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    rows = live.select("bucket", _half(F.col("bucket")).alias("band"), "id", "class", "weight", (F.col("class") == F.col("main")).alias("in_main"), chunks(F.col("shingles")).alias("wide"), chunks(F.col("outside")).alias("high"), F.xxhash64("id").alias("h"))
    mine, its = F.pmod("h", F.col("high")), F.pmod("h", F.col("wide"))
    ones = rows.where("not in_main").select("bucket", "band", "id", "class", "weight", F.lit(0).alias("side"), mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    others = rows.select("bucket", "band", "id", "class", "weight", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), its.alias("j"))
    blocks = ones.withColumn("i", F.col("i").cast("int")).unionByName(others.withColumn("j", F.col("j").cast("int"))).join(held, "id")
    kind = live.schema["class"].dataType
    arrow = to_arrow_type(kind)

    def settle(table: pa.Table) -> pa.Table:
        found = _settle(table, least, enough)
        return pa.table({"a": pa.array([x for x, _ in found], arrow), "b": pa.array([x for _, x in found], arrow)})

    return blocks.groupBy("bucket", "i", "j").applyInArrow(settle, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id that links reach, by minima of neighbours and by jumping to a label's own label."""
    both = kept_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = kept_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("class")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jumped = lower.join(labels.select(F.col("id").alias("class"), F.col("class").alias("jump")), "class", "left").select("id", "was", F.least("class", F.coalesce("jump", "class")).alias("class"))
        jumped = kept_table(jumped, "labels")
        labels = jumped.select("id", "class")
        if jumped.where("class <> was").isEmpty():
            return labels


def _moved(rows: DataFrame, step: DataFrame) -> DataFrame:
    """``rows`` with each class replaced by the one that ``step`` (class, to) names."""
    return rows.join(step, "class", "left").withColumn("class", F.coalesce("to", "class")).drop("to").select(*rows.columns)


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, class_id, n_shingles, representative) of each row: class_id is the smallest id that links of ``least`` or more reach.

    Texts of equal words are linked whatever they are. A null, an empty or a blank text
    has no shingle and is a class of its own. Rows that share an id are one document. A
    null id has a null class. Repeated rows each give a row; an empty table gives none;
    other columns are not read.
    """
    signed = kept_table(_signed(df, id_col, text, bands, rows, shingle), "signed")
    full = signed.where(F.col("id").isNotNull() & (F.col("weight") > 0))
    copies = kept_table(full.groupBy("sha").agg(F.min("id").alias("first"), F.min_by(F.struct("weight", "bands", "places"), "id").alias("of")), "copies")
    placed = copies.select(F.col("first").alias("id"), F.col("first").alias("class"), F.col("of.weight").alias("weight"), F.explode("of.bands").alias("bucket"))
    size = bands * rows
    live = kept_table(placed.join(_mixed(placed), "bucket"), "live")
    members = live.select("id").distinct()
    signs = kept_table(copies.select(F.col("first").alias("id"), F.col("of.places").alias("places")).join(members, "id", "left_semi"), "signs")
    texts = kept_table(df.select(F.col(id_col).alias("id"), F.col(text).alias("body")).join(members, "id", "left_semi"), "texts")
    new = kept_table(verified(likely(_led(live, least).distinct(), signs, least, size), texts, least, shingle), "links")
    labels = members.withColumn("class", F.col("id"))
    if not new.isEmpty():
        step = components(new).select(F.col("id").alias("class"), F.col("class").alias("to"))
        labels = kept_table(_moved(labels, step), "labels")
        placed = _moved(live.select("bucket", "id", "class", "weight"), step)
        live = kept_table(placed.join(_mixed(placed), "bucket"), "live")
    crossed = verified(likely(_crossed(live.where("few"), least).distinct(), signs, least, size), texts, least, shingle)
    blocks = _in_blocks(live.where("not few"), copies, texts, least, least_places(least, size), shingle)
    new = kept_table(crossed.union(blocks).distinct(), "links")
    if not new.isEmpty():
        labels = _moved(labels, components(new).select(F.col("id").alias("class"), F.col("class").alias("to")))
    named = copies.select("sha", "first")
    named = named.join(labels.select(F.col("id").alias("first"), "class"), "first", "left").withColumn("first", F.coalesce("class", "first")).drop("class")
    named = named.withColumnRenamed("first", "__class")
    out = signed.select("id", "sha", "weight").join(named, "sha", "left")
    own = F.col("id").isNotNull() & (F.col("weight") > 0)
    group = F.when(own, F.col("__class")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), group.alias("class_id"), F.col("weight").alias("n_shingles"), F.coalesce(group == F.col("id"), F.lit(True)).alias("representative"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one document of each class: that with the smallest id. Rows with a null id stay.

    A document is an id and a text: an id with several texts is as many documents, of
    which the one with the smaller hash stands first; repeats of one document give a row.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text"))
    full = F.col(id_col).isNotNull()
    found = classes(df.where(full).select(key.alias("__key"), text), "__key", text, **options)
    kept = found.where("representative").select(F.col("__key.id").alias("__id"), F.col("__key.text").alias("__text")).distinct()
    rows = df.where(full).withColumn("__hash", F.xxhash64(F.col(text)))
    named = rows.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__hash") == F.col("__text")), "left_semi").dropDuplicates([id_col, "__hash"]).drop("__hash")
    return named.unionByName(df.where(F.col(id_col).isNull()))

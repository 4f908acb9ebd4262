"""One document of each group of near copies, found by SimHash first and exactly in the end.

Near copies are texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more; groups are what such links connect.  Texts of one set are one class.

1. Fingerprints of the shingles are joined on pigeonhole blocks (see ``simhash``).
   Classes within 3 bits are candidates, the first to be compared.
2. 64 bits cannot promise a similarity of 0.8: at that similarity fingerprints differ
   in about 10 bits, often in more.  The candidates they miss come from a prefix join.
   Shingles are put in one global order; two similar sets of n and m share a shingle
   among the first n - ceil(0.8 n) + 1 of either, and behind the first one shared
   enough must be left of both (positional filter).  Sets that share too few of their
   first shingles cannot be similar either (counting filter).  Any order gives the same
   result; this one has shingles last that are common in a sample of the documents.
3. Each class is compared with its best candidate.  Of the other candidates only those
   from different groups so far are compared, which is all that groups need.

A first shingle of more than CROWD classes (a large group of near copies) gives no
pairs at first: there each class is a candidate of one centre, then of one class of
each of the largest other groups, and in the end of the classes that are still apart.  Common shingles are dealt by salt, so no task needs a whole one.

Candidates have odd sketches that allow the similarity: 512 bits, each the parity of
the number of shingles that fall to it.  Each shingle that only one of two sets has
changes one bit, so sets of n and m that are similar differ in (n + m) / 9 bits at most.

Texts travel only where they can be needed: a bitmap of bounded size, built from the
ids in question, lets rows pass before they are shuffled.

Shingles and sets are told apart by 64-bit hashes.  Texts under five words have one
shingle of all their words; texts without words (null and empty ones) are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph.components import connected_components
from ..shared import shuffles_dropped, written
from .arrays import shingles_of_texts
from .bitmap import with_bitmap
from .common import checkpointed, lean, runs_of_rows
from .simhash import near_links

SHINGLE = 5
SIMILARITY = 0.8
#: A first shingle with more classes than this is linked through a centre.
CROWD = 8
#: Classes of one shingle that meet all others of it in one task, and texts that meet one text there.
CHUNK = 1000
#: One document of so many gives the order of shingles; so many common ones are known to it.
SAMPLE, COMMON = 16, 50_000
#: Text bytes whose shingles a task works out together.
STEP = 500_000
#: Components of a crowded shingle that all its classes are compared with, and how often, before its pairs are.
CENTRES, ROUNDS = 8, 1
#: Binary logarithm of the bits of an odd sketch.
ODD_BITS = 9


def shingle_sets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one text behind another; where each begins (and an end); bits set in over half of its shingles."""
    hashes, of = shingles_of_texts([t.encode().lower() for t in texts], n)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    prints = np.zeros(len(texts), np.uint64)
    for i in range(len(texts)):
        own = hashes[begin[i] : begin[i + 1]]
        total = np.zeros(64, np.int64)
        for a in range(0, len(own), 65536):
            total += np.unpackbits(own[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        prints[i] = np.packbits(total * 2 > len(own), bitorder="little").view("<u8")[0]
    return hashes, begin, prints


def class_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(begin[:-1], begin[1:], strict=True)], np.uint64).view(np.int64)


def odd_sketches(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each set a row of 64-bit words: the parities of its hashes by their first bits."""
    n = len(begin) - 1
    out = np.zeros((n, (1 << ODD_BITS) // 64), np.uint64)
    for i in range(n):
        counts = np.bincount((hashes[begin[i] : begin[i + 1]] >> np.uint64(64 - ODD_BITS)).astype(np.int64), minlength=1 << ODD_BITS)
        out[i] = np.packbits(counts & 1, bitorder="little").view("<u8")
    return out


def with_classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, class, n (shingles of its set), fp (fingerprint), odd (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches, most=STEP):
            hashes, begin, prints = shingle_sets(batch.column("text").to_pylist())
            odd = odd_sketches(hashes, begin)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, odd.shape[1]).astype(np.int32)), pa.array(odd.view(np.int64).ravel()))
            arrays = [batch.column("doc_id"), batch.column("row_hash"), pa.array(class_keys(hashes, begin)), pa.array(np.diff(begin).astype(np.int32)), pa.array(prints.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_hash", "class", "n", "fp", "odd"])

    return docs.mapInArrow(lean(run), "doc_id long, row_hash long, class long, n int, fp long, odd array<long>")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample, sorted, and their counts; they order and deal shingles and decide nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches, most=STEP):
            value, n = np.unique(shingle_sets(batch.column("text").to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["shingle", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(lean(run), "shingle long, n long")
    often = part.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    rows = often.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    value = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], np.array([r["n"] for r in rows], np.int64)[order]


def required(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n that a similar one has at least."""
    return np.ceil(SIMILARITY * n - 1e-9).astype(np.int64)


def first_shingles(docs: DataFrame) -> DataFrame:
    """class, n (shingles of its set), first (its first shingles in the global order), salts (how many ways each is dealt)."""
    common, count = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of_rows(batches, most=STEP):
            hashes, begin, _ = shingle_sets(batch.column("text").to_pylist())
            level = np.zeros(len(hashes), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                level = np.where(common[at] == hashes, count[at], 0)
            size = np.diff(begin)
            of = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((hashes, level, of))
            place = np.arange(len(hashes)) - begin[of]
            own = order[place <= (size - required(size))[of]]
            ends = np.concatenate([[0], np.cumsum(np.minimum(size, size - required(size) + 1))]).astype(np.int32)
            salts = (1 + level[own] * SAMPLE // CHUNK).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (hashes[own].view(np.int64), salts)]
            yield pa.RecordBatch.from_arrays([pa.array(class_keys(hashes, begin)), pa.array(size.astype(np.int32)), *lists], ["class", "n", "first", "salts"])

    rows = docs.mapInArrow(lean(run), "class long, n int, first array<long>, salts array<int>")
    return rows.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "first", "salts")))  # equal in all rows of a class


def may_meet(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Can sets of n and m whose first shared shingle is at places i and j be similar?"""
    return F.least(n - i, m - j) * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6


def alike(n: Column, x: Column, m: Column, y: Column) -> Column:
    """Do the odd sketches x and y allow sets of n and m to be similar?"""
    bits = sum((F.bit_count(F.get(x, k).bitwiseXOR(F.get(y, k))) for k in range((1 << ODD_BITS) // 64)), F.lit(0))
    return bits * (1 + SIMILARITY) <= (1 - SIMILARITY) * (n + m) + 1e-6


def alike_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of classes (a, b, weight) whose sketches allow the similarity."""
    of = lambda c: sketches.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(alike(F.col("n_a"), F.col("odd_a"), F.col("n_b"), F.col("odd_b"))).select(*pairs.columns)


def shared_shingles(classes: DataFrame) -> DataFrame:
    """shingle, class, n, at, members (classes that have it among their first), centre: rows of shingles of two classes or more."""
    placed = classes.select("class", "n", F.posexplode(F.arrays_zip(F.col("first").alias("shingle"), F.col("salts").alias("salts"))).alias("at", "x")).select("class", "n", "at", "x.*")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))
    own = Window.partitionBy("shingle", "salt")
    counted = placed.withColumn("members", F.count("*").over(own)).withColumn("centre", F.min(F.struct("class", "n", "at")).over(own))
    counted = checkpointed(counted.where("members > 1 OR salts > 1"))
    dealt = counted.where("salts > 1")
    parts = dealt.groupBy("shingle", "salt").agg(F.first("members").alias("members"), F.first("centre").alias("centre"))
    whole = parts.groupBy("shingle").agg(F.sum("members").alias("members"), F.min("centre").alias("centre")).where("members > 1")
    columns = ["shingle", "class", "n", "at", "members", "centre"]
    return counted.where("salts = 1").select(*columns).unionByName(dealt.drop("members", "centre").join(whole, "shingle").select(*columns))


def calm_pairs(held: DataFrame) -> DataFrame:
    """a, b, weight: pairs of classes (a < b) that may be similar, through shingles of few classes; weight: shingles shared."""
    calm = held.where(F.col("members") <= CROWD)
    met = calm.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("class", "n", "at"))).alias("all"))  # CROWD at most
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, CROWD), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    x, y = F.col("p.x"), F.col("p.y")
    n, m = x["n"], y["n"]
    met = met.select(F.explode(pairs).alias("p")).where((F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-6) & (x["class"] != y["class"]))
    found = met.groupBy(x["class"].alias("a"), y["class"].alias("b")).agg(F.count("*").alias("weight"), F.max(may_meet(n, x["at"], m, y["at"])).alias("ok"), F.first(n).alias("n"), F.first(m).alias("m")).where("ok")
    crowded = held.where(F.col("members") > CROWD).groupBy("class").agg(F.count("*").alias("more"))
    found = found.join(crowded.select(F.col("class").alias("a"), F.col("more").alias("more_a")), "a", "left").join(crowded.select(F.col("class").alias("b"), F.col("more").alias("more_b")), "b", "left")
    most = F.col("weight") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) + F.greatest(F.ceil(SIMILARITY * F.col("n") - 1e-9), F.ceil(SIMILARITY * F.col("m") - 1e-9)) - 1
    return found.where(most * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + F.col("m")) - 1e-6).select("a", "b", "weight")


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def centre_pairs(crowd: DataFrame) -> DataFrame:
    """a, b, weight: classes of crowded shingles and the centres of these."""
    c = F.col("centre")
    near = crowd.where((F.col("class") != c["class"]) & may_meet(F.col("n"), F.col("at"), c["n"], c["at"]))
    return near.groupBy(*ordered(F.col("class"), c["class"])).agg(F.count("*").alias("weight"))


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """a, b, weight: classes whose fingerprints are close, through the smallest class of each fingerprint."""
    own = prints.groupBy("fp").agg(F.min("class").alias("first"))
    same = prints.select("fp", "class").join(own, "fp").where("class != first").select("class", "first")
    links = near_links(own.select("fp"))
    left, right = own.select(F.col("fp").alias("a"), F.col("first").alias("x")), own.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    close = links.join(left, "a").join(right, "b").select("x", "y")
    return same.unionByName(close.toDF("class", "first")).select(*ordered(F.col("class"), F.col("first"))).distinct().withColumn("weight", F.lit(1 << 30).cast("long"))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the similarity.

    The text of the end with more pairs comes first in a partition (by salt, if these
    are many), and the texts it is to be compared with pass by it one at a time.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("pairs"))
    of = lambda c: ends.select(F.col("class").alias(c), F.col("pairs").alias(f"pairs_{c}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    turn = F.col("pairs_a") >= F.col("pairs_b")
    both = both.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("key"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("class"), F.ceil(F.greatest("pairs_a", "pairs_b") / CHUNK).cast("int").alias("salts"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))
    roles = both.select("class", "key", "salt", F.lit(1).alias("side")).unionByName(both.select(F.col("key").alias("class"), "key", "salt", F.lit(0).alias("side")).distinct())
    wanted = checkpointed(roles.join(reps, "class"))
    texts = with_bitmap(docs, wanted.select("doc_id")).where("maybe").drop("maybe")
    placed = texts.join(wanted, ["doc_id", "row_hash"]).select("key", "salt", "side", "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in runs_of_rows([batch], most=STEP):
                hashes, begin, _ = shingle_sets(part.column("text").to_pylist())
                a, b = [], []
                for i, (key, side, other) in enumerate(zip(part.column("key").to_pylist(), part.column("side").to_pylist(), part.column("class").to_pylist(), strict=True)):
                    s = hashes[begin[i] : begin[i + 1]]
                    if not side:
                        now, own = key, s.copy()
                    elif now == key:
                        n = len(np.intersect1d(own, s, assume_unique=True))
                        if n >= SIMILARITY * (len(own) + len(s) - n) - 1e-9:
                            a.append(min(key, other))
                            b.append(max(key, other))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.repartition("key", "salt").sortWithinPartitions("key", "salt", "side").mapInArrow(lean(run), "a long, b long")


def with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    groups = connected_components(links, "a", "b", written).withColumnRenamed("node", "class")
    return rows.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))


def stars(components: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is in one component already: each class with the smallest one."""
    return components.where("class != component").select(F.col("class").alias("a"), F.col("component").alias("b"))


def apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (a, b, weight) whose ends are in different components."""
    of = lambda c: components.select(F.col("class").alias(c), F.col("component").alias(f"component_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("component_a != component_b").select("a", "b", "weight")


def mixed_crowd(crowd: DataFrame, components: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of crowded shingles whose classes are in different components, with component and sketch."""
    named = crowd.select("shingle", "class", "n", "at", "members").join(components, "class")
    mixed = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    return checkpointed(named.join(mixed, "shingle", "left_semi").join(sketches.select("class", "odd"), "class"))


def may_link(x: str, y: str) -> Column:
    c = lambda t, k: F.col(f"{t}.{k}")
    return may_meet(c(x, "n"), c(x, "at"), c(y, "n"), c(y, "at")) & alike(c(x, "n"), c(x, "odd"), c(y, "n"), c(y, "odd"))


def pairs_with_centres(rest: DataFrame) -> DataFrame:
    """a, b, weight: each class with one of the CENTRES largest other components of a shingle, by a class of that; weight: its classes there."""
    least = rest.groupBy("shingle", "component").agg(F.count("*").alias("size"), F.min(F.struct("class", "n", "at", "odd")).alias("own"))
    place = F.row_number().over(Window.partitionBy("shingle").orderBy(F.desc("size"), "component"))
    centres = least.withColumn("place", place).where(F.col("place") <= CENTRES).select("shingle", "component", "size", "own.*")
    x, y = rest.alias("x"), centres.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y"))
    best = met.groupBy("x.class").agg(F.max(F.struct("y.size", F.col("y.class").alias("other"))).alias("best"))
    return best.select(*ordered(F.col("class"), F.col("best.other")), F.col("best.size").alias("weight"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """a, b: of the pairs (a, b, weight) the best one of each class."""
    ends = pairs.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("class"))
    return ends.groupBy("class").agg(F.max(F.struct("weight", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def crowd_pairs(rest: DataFrame) -> DataFrame:
    """a, b: classes of one crowded shingle that may be similar and are in different components."""
    rest = rest.withColumn("salts", F.ceil(F.col("members") / CHUNK).cast("int"))
    one = rest.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).alias("x")
    every = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    on = F.col("x.component") < F.col("y.component")
    for k in ("shingle", "salt"):
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return one.join(every, on & may_link("x", "y")).select(*ordered(F.col("x.class"), F.col("y.class"))).distinct()


def sharing_enough(pairs: DataFrame, held: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that share so many of their first shingles that they may be similar.

    Sets that are small for their sketches have been told apart by these; they are not counted.
    """
    size = lambda c: sketches.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"))
    n, m = F.col("n_a"), F.col("n_b")
    sized = checkpointed(pairs.join(size("a"), "a").join(size("b"), "b"))
    large = (1 - SIMILARITY) * (n + m) > (1 + SIMILARITY) * (1 << ODD_BITS) / 4
    counted = sized.where(large)
    ends = counted.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    # the first shingles of one class, in one row
    own = checkpointed(held.join(ends, "class", "left_semi").groupBy("class").agg(F.collect_list("shingle").alias("own")))
    of = lambda c: own.select(F.col("class").alias(c), F.col("own").alias(f"own_{c}"))
    shared = counted.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("own_a", "own_b")))
    most = F.col("shared") + F.greatest(F.ceil(SIMILARITY * n - 1e-9), F.ceil(SIMILARITY * m - 1e-9)) - 1
    return shared.where(most * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6).select("a", "b").unionByName(sized.where(~large).select("a", "b"))


def links(docs: DataFrame, prints: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes whose components are those of all similar pairs."""
    held = checkpointed(shared_shingles(first_shingles(docs)))
    crowd = held.where(F.col("members") > CROWD)
    calm = checkpointed(alike_pairs(calm_pairs(held), prints))
    more = alike_pairs(centre_pairs(crowd).unionByName(fingerprint_pairs(prints)), prints)
    tried = checkpointed(best_pairs(calm.unionByName(more).groupBy("a", "b").agg(F.sum("weight").alias("weight"))))
    components = checkpointed(with_components(reps.select("class"), checkpointed(verified(tried, docs, reps))))
    for _ in range(ROUNDS):
        rest, calm = mixed_crowd(crowd, components, prints), checkpointed(apart(calm, components))
        now = checkpointed(best_pairs(calm.unionByName(pairs_with_centres(rest))).join(tried, ["a", "b"], "left_anti"))
        tried, found = tried.unionByName(now), checkpointed(verified(now, docs, reps))
        components = checkpointed(with_components(reps.select("class"), stars(components).unionByName(found)))
    more = apart(calm, components).select("a", "b").unionByName(crowd_pairs(mixed_crowd(crowd, components, prints))).distinct()
    more = checkpointed(sharing_enough(more.join(tried, ["a", "b"], "left_anti"), held, prints))
    return stars(components) if more.isEmpty() else stars(components).unionByName(verified(more, docs, reps))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of all columns), component, component_id (its smallest doc_id), for rows with doc_id."""
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_hash")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), row_hash)
    rows = checkpointed(with_classes(docs))
    prints = rows.groupBy("class").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"), F.first(F.struct("n", "fp", "odd")).alias("x"))
    prints = checkpointed(prints.select("class", "x.*", "first.*"))
    reps = prints.select("class", "doc_id", "row_hash")
    named = with_components(reps, links(docs, prints, reps))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(smallest, "component").select("class", "component", "component_id")
    return rows.select("doc_id", "row_hash", "class").join(of, "class").select("doc_id", "row_hash", "component", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links of similar texts reach), for rows with doc_id."""
    with shuffles_dropped(docs.sparkSession):
        return grouped(docs).select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: one row of each group and all rows without doc_id stay.

    Of a group the row with the smallest doc_id stays; of rows that share it, the one
    with the smallest XXH64 (seed 42) of all columns.  Rows that share a doc_id but have
    no similar texts are in different groups, and each stays.
    """
    with shuffles_dropped(docs.sparkSession):
        return kept_rows(docs, checkpointed(grouped(docs)))


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each_group`` keeps of these groups."""
    shared = groups.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_hash")).alias("first")).where("n > 1")
    shared = checkpointed(shared.select("component", "first"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*columns).alias("row_hash"), F.struct(*columns).alias("row"))
    # rows alone in their group stay where they are; the others are looked up
    marked = with_bitmap(named.where(F.col("doc_id").isNotNull()), groups.join(shared, "component", "left_semi").select("doc_id"))
    alone = groups.join(shared, "component", "left_anti").select("doc_id", "row_hash")
    keep = checkpointed(shared.select("first.*").distinct().unionByName(alone))
    looked = marked.where("maybe").join(keep, ["doc_id", "row_hash"], "left_semi").dropDuplicates(["doc_id", "row_hash"])
    out = looked.select("row.*").unionByName(marked.where("NOT maybe").select("row.*"))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))

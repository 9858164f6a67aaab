"""N-gram Jaccard self-join by grouped prefixes, and its connected components.

A text's set holds the 64-bit hashes of its distinct word shingles. Two texts link when the intersection is at least
``share`` percent of the union. The steps:

1. Shingles are dealt to partitions by hash, as short keys packed into one row per chunk and partition, and those found
   once in all texts are told apart. Only texts with enough shared shingles to link to anything go on. A shingle that a
   chunk holds several times is counted there, so a frequent one is one small entry per chunk.
2. The remaining texts order their sets by frequency (of the ``warm`` most frequent shingles, by exact count; the rest count
   as rare) and hash. Texts with equal sets are one class; classes with the same size and prefix are one group.
3. Groups meet in the lists of their prefix shingles. First each group is paired only with the two leaders of
   each of its ``LISTS`` fullest lists, and classes are expanded and verified on their texts. Components of these links are
   found, and then every pair of a list that is still in different components is tried, if its places there allow a link. Pairs inside a component are left out: no component changes by them. So copies
   and near copies of one text cost one pair each, and no link between components is lost.
4. Components of all verified links carry the smallest id.

Defined cases: a null text or one without words has an empty set and stands alone; a text of fewer words than a shingle has
one, the whole sequence; rows that repeat id and text are one document, rows that repeat only the id are documents of their
own; a null id has no number to give to a component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuseval.llm.units import LOWER, chunks, coded, frugal, gather, split_units, spread, text_bytes
from corpuseval.session import materialize, ship_package

KEY_BITS = 24  # of a shingle's key within its partition; equal keys only ever let more texts pass
PARTITION_BYTES = 24_000_000  # of text for each partition of step 1
NO_TEXT = 0xFFFF
LISTS = 3  # of each group, those with most groups, whose two leaders it meets first
BATCH = 1000  # rows of an Arrow batch: texts and sets are large
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: pa.StringArray) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each): the distinct shingles of each row, ordered by hash."""
    data, bounds = text_bytes(column)
    units, of_text = split_units(LOWER[data], bounds)
    codes, names = coded(units)
    if not len(names):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    each = _word_hashes(names)[codes]
    counts = np.diff(of_text)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = gather(of_text[:-1], shingles)
    rows = np.repeat(np.arange(len(counts)), shingles)
    room = np.minimum(counts[rows], size)
    h = np.full(len(starts), 7, dtype=np.uint64)
    for k in range(size):
        here = each[np.minimum(starts + k, len(each) - 1)]
        h = np.where(k < room, _mixed(h * MIX + here), h)
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[first], rows[first]


def _place(h: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and key of each hash; both keep the order of the hashes."""
    part = ((h >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    low = ((h >> np.uint64(32)) * np.uint64(partitions)) & np.uint64(0xFFFFFFFF)
    return part.astype(np.int64), (low >> np.uint64(32 - KEY_BITS)).astype(np.int64)


def global_key(h: np.ndarray, partitions: int) -> np.ndarray:
    part, key = _place(h, partitions)
    return (part << KEY_BITS) | key


SPLIT = "bucket bigint, part bigint, chunk bigint, keys binary, refs binary, often binary, ids array<bigint>, n binary, u binary"
NAMES = ["bucket", "part", "chunk", "keys", "refs", "often", "ids", "n", "u"]


def _split(partitions: int, buckets: list[int], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: a chunk's texts with their sets' sizes and how many of each the chunk repeats; its keys for a partition.

    A chunk's number comes from its partition, so a retried task gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, chunk in enumerate(chunks(batches, 1), start=base):
            ids = chunk.column(0).to_numpy(zero_copy_only=False)
            h, rows = shingle_sets(chunk.column(1), size)
            part, key = _place(h, partitions)
            at = part << KEY_BITS | key
            new = np.ones(len(at), dtype=bool)
            new[1:] = at[1:] != at[:-1]
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(at)))
            alone = np.repeat(counts == 1, counts)
            n = np.bincount(rows, minlength=len(ids)).astype("<u4").tobytes()
            own = np.bincount(rows[~alone], minlength=len(ids)).astype("<u4").tobytes()
            out = [(number, None, number, None, None, None, ids, n, own)]
            values, parts, refs = key[starts], part[starts], np.where(counts == 1, rows[starts], NO_TEXT)
            ends = np.searchsorted(parts, np.arange(partitions + 1))
            for p in np.flatnonzero(np.diff(ends)):
                v, r, c = (x[ends[p] : ends[p + 1]] for x in (values, refs, counts))
                often = c[r == NO_TEXT].astype("<u2").tobytes()
                out.append((buckets[p], int(p), number, _gaps(v), r.astype("<u2").tobytes(), often, None, None, None))
            kinds = [*[pa.int64()] * 3, *[pa.binary()] * 3, pa.list_(pa.int64()), *[pa.binary()] * 2]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    return run


def _gaps(keys: np.ndarray) -> bytes:
    """Ascending keys as 16-bit steps; a step of 65535 adds up with the next."""
    steps = np.diff(keys, prepend=0)
    long = steps // 0xFFFF
    at = np.arange(len(steps)) + np.cumsum(long)
    out = np.full(len(steps) + int(long.sum()), 0xFFFF, dtype="<u2")
    out[at] = steps % 0xFFFF
    return out.tobytes()


def _ungaps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, dtype="<u2").astype(np.int64)
    return np.cumsum(steps)[steps != 0xFFFF]


FOUND = "chunk bigint, ids array<bigint>, n binary, u binary, refs binary, warm bigint, df bigint"


def _shared(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many of each text's keys other chunks have, one row per chunk; and the keys of at least ``least`` texts with their counts."""
    names = ["chunk", "ids", "n", "u", "refs", "warm", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, counts, numbers = [], [], [], []
        for batch in batches:
            texts = batch.filter(batch.column(1).is_null())
            if k := texts.num_rows:
                columns = [texts.column(2), *texts.columns[6:], pa.nulls(k, pa.binary()), *[pa.nulls(k, pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            for row in batch.filter(batch.column(1).is_valid()).select(NAMES[1:6]).to_pylist():
                refs = np.frombuffer(row["refs"], dtype="<u2").astype(np.int64)
                many = refs == NO_TEXT
                count = np.ones(len(refs), dtype=np.int64)
                count[many] = -np.frombuffer(row["often"], dtype="<u2").astype(np.int64)
                keys.append(row["part"] << KEY_BITS | _ungaps(row["keys"]))
                owners.append(len(numbers) << 16 | refs)
                counts.append(count)
                numbers.append(row["chunk"])
        if not keys:
            return
        key, owner, count = (np.concatenate(x) for x in (keys, owners, counts))
        del keys, owners, counts
        order = np.argsort(key, kind="stable")
        key, owner, count = key[order], owner[order], count[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        df = np.add.reduceat(np.abs(count), starts)
        found, n = np.unique(owner[np.repeat(sizes > 1, sizes) & (count > 0)], return_counts=True)
        ends = np.searchsorted(found >> 16, np.arange(len(numbers) + 1))
        out = []
        for k in np.flatnonzero(np.diff(ends)):
            refs, u = (x[ends[k] : ends[k + 1]] for x in (found & 0xFFFF, n))
            out.append((numbers[k], u.astype("<u4").tobytes(), refs.astype("<u2").tobytes()))
        chunk, u, refs = zip(*out, strict=True) if out else ((), (), ())
        m, long = len(out), pa.int64()
        arrays = [pa.array(chunk, long), pa.nulls(m, pa.list_(long)), pa.nulls(m, pa.binary()), pa.array(u, pa.binary()), pa.array(refs, pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(m, long), pa.nulls(m, long)], names=names)
        warm = df >= least
        m = int(warm.sum())
        none = [pa.nulls(m, k) for k in (long, pa.list_(long), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(key[starts][warm]), pa.array(df[warm])], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set size and shared shingles, from its chunk's rows, which all come to one task."""
    texts: dict[int, dict] = {}
    more: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["refs"] is None:
                texts[row["chunk"]] = row
            else:
                more.setdefault(row["chunk"], []).append((row["refs"], row["u"]))
    for chunk, row in texts.items():
        u = np.frombuffer(row["u"], dtype="<u4").astype(np.int64)
        for refs, count in more.pop(chunk, []):
            u[np.frombuffer(refs, dtype="<u2")] += np.frombuffer(count, dtype="<u4")
        n = np.frombuffer(row["n"], dtype="<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(n), pa.array(u)], names=["row_key", "n", "u"])


SETS = "row_key bigint, n bigint, klass bigint, family bigint, prefix array<bigint>"


def _ordered(
    partitions: int, warm: np.ndarray, df: np.ndarray, size: int, share: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets in the global order with their prefix, and the hashes that name the class and the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            h, rows = shingle_sets(chunk.column(1), size)
            at = np.minimum(np.searchsorted(warm, keys := global_key(h, partitions)), max(len(warm) - 1, 0))
            count = np.where(warm[at] == keys, df[at], 0) if len(warm) else np.zeros(len(h), dtype=np.int64)
            order = np.lexsort((h, count, rows))
            h, rows = h[order], rows[order]
            n = np.bincount(rows, minlength=chunk.num_rows)
            ends = np.concatenate([[0], np.cumsum(n)])
            long = np.minimum(n, n - -(-share * n // 100) + 1)
            place = np.arange(len(h), dtype=np.uint64) - ends[rows].astype(np.uint64)
            chained = _mixed(h + place * MIX)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(chained, dtype=np.uint64)])
            klass = _mixed(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64) * MIX)
            family = _mixed(sums[ends[:-1] + long] - sums[ends[:-1]] + n.astype(np.uint64))
            take = gather(ends[:-1], long)
            prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(long)]).astype(np.int32), pa.array(h[take].view(np.int64)))
            arrays = [chunk.column(0), pa.array(n), pa.array(klass.view(np.int64)), pa.array(family.view(np.int64)), prefix]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_key", "n", "klass", "family", "prefix"])

    return run


def _verified(size: int, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of texts whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 2):
            (h, rows), (g, others) = (shingle_sets(chunk.column(k), size) for k in (2, 3))
            h, rows = np.concatenate([h, g]), np.concatenate([rows, others])
            order = np.lexsort((h, rows))
            h, rows = h[order], rows[order]
            both = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=chunk.num_rows)
            union = np.bincount(rows, minlength=chunk.num_rows) - both
            yield chunk.select(["a", "b"]).filter(pa.array(100 * both >= share * union))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach. Labels move along edges and skip along labels."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("skip"))
        moved = materialize(met.join(up, "low").select("node", F.least("low", "skip").alias("label"), (F.least("low", "skip") < F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _size_fits(share: int) -> Column:
    return 100 * F.least("na", "nb") >= share * F.greatest("na", "nb")


def _places_fit(share: int) -> Column:
    """Whether two sets that first meet at these places of their order can share enough shingles.

    A pair must pass at its first common shingle only: nothing before it is common, so what follows bounds the intersection.
    """
    return (100 + share) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= share * (F.col("na") + F.col("nb"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the tables written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    share: int = 75,
    warm_texts: int = 64,
    warm: int = 200_000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship_package(spark)
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))
    rows = docs.select(key.alias("row_key"), F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"))
    texts = rows.select("row_key", "text")

    volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PARTITION_BYTES))
    # a bucket number for each partition, so that every partition gets exactly one
    numbers = spark.range(40 * partitions).groupBy(F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).agg(F.min("id").alias("id"))
    found = {r.p: r.id for r in numbers.collect()}
    buckets = [found.get(p, p) for p in range(partitions)]
    dealt = texts.mapInArrow(frugal(_split(partitions, buckets, size)), SPLIT).repartition(partitions, "bucket")
    with batches_of(spark, BATCH):
        seen = materialize(dealt.mapInArrow(frugal(_shared(warm_texts)), FOUND))
        by_chunk = seen.where("chunk is not null").select("chunk", "ids", "n", "u", "refs").repartition(partitions, "chunk")
        sizes = by_chunk.mapInArrow(frugal(_summed), "row_key bigint, n bigint, u bigint")
        sizes = materialize(sizes.groupBy("row_key").agg(F.max("n").alias("n"), F.sum("u").alias("u")))
    chosen = sizes.where((F.col("n") > 0) & (100 * F.col("u") >= share * F.col("n"))).select("row_key")
    if chosen.count() <= broadcast_rows:
        chosen = F.broadcast(chosen)
    often = seen.where("warm is not null").orderBy(F.desc("df"), "warm").limit(warm).select("warm", "df").toArrow().sort_by("warm")
    order = [often.column(i).to_numpy() for i in range(2)]
    similar = texts.join(chosen, "row_key", "left_semi")
    with batches_of(spark, BATCH):
        sets = materialize(similar.mapInArrow(frugal(_ordered(partitions, *order, size, share)), SETS))

    classes = materialize(
        sets.groupBy("klass").agg(F.first("family").alias("family"), F.first("n").alias("n"), F.min("row_key").alias("row_key"))
    )
    kin = classes.select("family", "klass", "n")
    heads = classes.groupBy("family").agg(F.min("row_key").alias("row_key"))
    heads = sets.join(heads, ["family", "row_key"]).dropDuplicates(["family"])
    lists = heads.select(F.posexplode("prefix").alias("place", "token"), "family", "n")
    # leaders: the set in which the list's shingle comes earliest, so with the fewest rarer ones, and the smallest
    leaders = lists.groupBy("token").agg(
        F.count("*").alias("many"),
        F.min("family").alias("l1"),
        F.min_by("family", F.struct(F.col("place") / F.col("n"), "family")).alias("l2"),
    ).where("many > 1")
    lists = materialize(lists.join(leaders, "token"))

    named_texts = classes.select("klass", "row_key")
    if named_texts.count() <= broadcast_rows:
        named_texts = F.broadcast(named_texts)
    whole = materialize(texts.join(named_texts, "row_key").select("klass", "text").dropDuplicates(["klass"]))

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among pairs of classes. Texts take less room than their sets."""
        side = lambda name: whole.select(F.col("klass").alias(name), F.col("text").alias(f"t{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        with batches_of(spark, BATCH):
            return materialize(both.mapInArrow(frugal(_verified(size, share)), "a bigint, b bigint"))

    def expanded(pairs: DataFrame) -> DataFrame:
        """Pairs of classes from pairs of groups (fa, fb), which may be one group twice."""
        left = kin.select(F.col("family").alias("fa"), F.col("klass").alias("ka"), F.col("n").alias("na"))
        right = kin.select(F.col("family").alias("fb"), F.col("klass").alias("kb"), F.col("n").alias("nb"))
        both = pairs.join(left, "fa").join(right, "fb").where("ka <> kb").where(_size_fits(share))
        return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()

    fullest = W.partitionBy("family").orderBy(F.desc("many"), "token")
    own_lists = lists.withColumn("nth", F.row_number().over(fullest)).where(F.col("nth") <= LISTS)
    pairs = own_lists.select("family", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("other")).where("family <> other")
    first = materialize(pairs.select(F.least("family", "other").alias("fa"), F.greatest("family", "other").alias("fb")).distinct())
    inner = kin.groupBy("family").agg(F.count("*").alias("many"), F.min("klass").alias("head")).where("many > 1")
    inside = kin.join(inner, "family").where("klass <> head").select(F.least("klass", "head").alias("a"), F.greatest("klass", "head").alias("b"))
    links = verify(expanded(first).union(inside).distinct())

    labels = components(links)
    named = kin.join(labels.withColumnRenamed("node", "klass"), "klass", "left").withColumn("label", F.coalesce("label", "klass"))
    named = materialize(named)
    each = lists.select("token", "family", "place").union(kin.select(F.col("family").alias("token"), "family", F.lit(0)).distinct())
    spots = each.join(named, "family").select("token", "klass", "n", "place", "label")
    mixed = spots.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_spots = materialize(spots.join(mixed, "token"))
    side = lambda x: [F.col(old).alias(new + x) for old, new in (("klass", ""), ("n", "n"), ("place", "p"), ("label", "l"))]
    left, right = open_spots.select("token", *side("a")), open_spots.select("token", *side("b"))
    rest = left.join(right, "token").where("a < b and la <> lb").where(_size_fits(share) & _places_fit(share)).select("a", "b").distinct()
    tried = expanded(first).union(inside)
    more = verify(rest.join(tried, ["a", "b"], "left_anti"))
    final = components(links.union(more))

    by_class = sets.select("row_key", "klass").distinct().join(final.withColumnRenamed("node", "klass"), "klass", "left")
    nodes = by_class.select("row_key", F.coalesce("label", "klass").alias("label"))
    ids = rows.select("row_key", "doc_id").distinct().join(sizes.select("row_key", "n"), "row_key")
    ids = materialize(ids.join(nodes, "row_key", "left"))
    smallest = ids.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return ids.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )

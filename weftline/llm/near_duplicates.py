"""N-gram Jaccard join of documents with themselves by MinHash banding.

Each text's set of word shingles is sketched once. Equal sets collapse to one representative; representatives that
share a band are candidates and meet in the bucket of that band. Buckets that share most of their members are merged;
each is compared in blocks on the full shingle sets, so a large bucket is spread over many tasks and a chain of
candidates costs no more than its buckets. What leaves a task is a link count for each document and a spanning forest
of the links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components, look_up
from weftline.llm.shingles import mix, shingle_sets
from weftline.llm.tokens import PieceCodec
from weftline.session import materialize

#: Bands and rows per band: a pair at the threshold of 0.8 is found with probability 1 - (1 - 0.8**6)**32 = 0.99994.
BANDS, ROWS = 32, 6
#: Similarity of a link, as the whole numbers 4 / 5.
ABOVE, BELOW = 4, 5
#: Least and most representatives in a block of a bucket that is compared, and code points of a block.
LEAST_BLOCK, MOST_BLOCK, BLOCK_CHARS = 512, 2048, 4 << 20
#: Shingles compared at once, which bounds the memory of a comparison.
COLUMNS = 2048

MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))
BAND_STEPS = mix(np.arange(2001, ROWS + 2001, dtype=np.uint64)) | np.uint64(1)
BAND_SEEDS = mix(np.arange(3001, BANDS + 3001, dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band of the MinHash signature of a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * MULTIPLIERS + SHIFTS).min(0), out=least)
    return mix((least.reshape(BANDS, ROWS) * BAND_STEPS).sum(1, dtype=np.uint64) + BAND_SEEDS)


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, keys of the text and of its shingle set (null without words), its length and the band keys, of each row of ``docs(doc_id, text)``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        for batch in batches:
            keys, bands = [], []
            for own in shingle_sets(batch.column(1)):
                keys.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands.append(band_keys(own).view(np.int64) if len(own) else None)
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "chars", "set_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"), F.length(F.col("text").cast("string")).cast("long").alias("chars"))
    return rows.mapInArrow(sketch, "doc_id long, text_key long, chars long, set_key binary, bands array<long>")


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Which of the sets a and b have a Jaccard similarity of ``ABOVE / BELOW`` or more."""
    sizes_a, sizes_b = (np.array([len(s) for s in sets], np.int64) for sets in (sets_a, sets_b))
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    rows_a, rows_b = np.repeat(np.arange(len(sets_a)), sizes_a), np.repeat(np.arange(len(sets_b)), sizes_b)
    columns = np.intersect1d(flat_a, flat_b)
    common = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for at in range(0, len(columns), COLUMNS):
        some = columns[at : at + COLUMNS]
        marks = []
        for flat, rows, n in ((flat_a, rows_a, len(sets_a)), (flat_b, rows_b, len(sets_b))):
            place = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[place] == flat
            marks.append(np.zeros((n, len(some)), np.float32))
            marks[-1][rows[hit], place[hit]] = 1
        common += marks[0] @ marks[1].T
    return (ABOVE + BELOW) * common >= ABOVE * (sizes_a[:, None] + sizes_b[None, :])


def share_one(lists: list[list[int]]) -> np.ndarray:
    """Which of the rows have a number in common."""
    sizes = np.array([len(own) for own in lists], np.int64)
    values, place, often = np.unique(np.array([b for own in lists for b in own], np.int64), return_inverse=True, return_counts=True)
    rows, common = np.repeat(np.arange(len(lists)), sizes), np.zeros((len(lists), len(lists)), bool)
    useful = np.flatnonzero(often > 1)
    for at in range(0, len(useful), COLUMNS // 2):
        some = useful[at : at + COLUMNS // 2]
        to = np.minimum(np.searchsorted(some, place), len(some) - 1)
        hit = some[to] == place
        marks = np.zeros((len(lists), len(some)), np.float32)
        marks[rows[hit], to[hit]] = 1
        common |= marks @ marks.T > 0
    return common


def forest(ids: list[int], links: np.ndarray) -> list[int]:
    """For each id the least id that the symmetric matrix of links connects it with."""
    order = np.argsort(ids, kind="stable")
    root = np.full(len(ids), -1)
    for start in order:
        if root[start] >= 0:
            continue
        root[start] = start
        todo = [start]
        while todo:
            new = np.flatnonzero(links[todo].any(0) & (root < 0))
            root[new] = start
            todo = new.tolist()
    return [ids[r] for r in root]


def compare(members: DataFrame) -> DataFrame:
    """rep, other and links of each representative in each block pair it is in.

    ``members(key, i, j, rep, block, copies, text, earlier)`` has the rows of a block pair (key, i, j) next to each
    other; ``earlier`` are the row's other buckets with a lesser key. ``links`` counts the documents that are linked
    to ``rep`` across the pair and that it doesn't meet in an earlier bucket already; ``other`` is the least
    representative that the pair's links connect it with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        key, rows = None, []

        def result() -> pa.RecordBatch:
            sets = list(shingle_sets(pa.array([r[3] for r in rows], pa.string())))
            ids, copies, block = [r[0] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows])
            n = len(rows)
            links = np.zeros((n, n), bool)
            if key[1] == key[2]:
                links = linked(sets, sets)
                np.fill_diagonal(links, False)
            elif len(a := np.flatnonzero(block == key[1])) and len(b := np.flatnonzero(block == key[2])):
                across = linked([sets[k] for k in a], [sets[k] for k in b])
                links[np.ix_(a, b)], links[np.ix_(b, a)] = across, across.T
            kept = np.flatnonzero(links.any(1))
            others = forest(ids, links)
            if len(kept) and any(r[4] for r in rows):
                links &= ~share_one([r[4] for r in rows])
            counts = (links @ copies)[kept]
            return pa.record_batch([pa.array([ids[k] for k in kept], pa.int64()), pa.array([others[k] for k in kept], pa.int64()), pa.array(counts, pa.int64())], ["rep", "other", "links"])

        for batch in batches:
            for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != key:
                    if len(rows) > 1:
                        yield result()
                    key, rows = (band, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield result()

    return members.select("key", "i", "j", "rep", "block", "copies", "text", "earlier").mapInArrow(run, "rep long, other long, links long")


def buckets(reps: DataFrame) -> DataFrame:
    """rep, and own: key, rows and chars of each bucket that it is compared in, by key; of ``reps(rep, bands, chars)``.

    A band's bucket of which half or more have the same largest bucket is merged into that one: near copies would
    meet in many buckets otherwise. A member of a bucket is in 32 at most, so a merged one is at most 32 times as
    large as the bucket that it is named after, whatever the data.
    """
    banded = reps.select("rep", F.explode("bands").alias("band"), "chars")
    n_rows = BANDS * reps.count()
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    met = look_up(banded, sizes, "band", n_rows)
    # a representative has as many buckets as bands at most
    mine = materialize(met.groupBy("rep").agg(F.collect_list(F.struct("size", "band")).alias("own"), F.max("chars").alias("chars")), "buckets")
    rows = mine.select("rep", "chars", F.array_max("own")["band"].alias("top"), F.explode("own.band").alias("band"))
    tops = rows.groupBy("band", "top").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "top")).alias("most"), F.sum("c").alias("n"))
    homes = tops.select("band", "n", F.when(2 * F.col("most.c") >= F.col("n"), F.col("most.top")).otherwise(F.col("band")).alias("home"))
    placed = materialize(look_up(rows, homes, "band", n_rows).select("rep", "chars", F.col("home").alias("key")).distinct(), "placed")
    totals = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("sum")).withColumn("size", F.col("n"))
    return look_up(placed.select("rep", "key"), totals, "key", n_rows).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("key", "size", "sum"))).alias("own"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of each row of ``docs(doc_id, text)``.

    Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; a text
    of one to four words is one shingle. ``n_links`` counts a document's links, equal texts among them; ``class_id``
    is the least doc_id of all documents that links connect, directly or through others. A text without a word (or
    null) has no link and is its own class. Rows that repeat a doc_id count as one more document each; a null doc_id
    gives a null class_id and no link. Other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with the keys of their texts and of their class's first text.

    A doc_id may have texts of several classes, so the class of a row is named by id and text key together. The key is
    64 bits wide: two different texts under one doc_id share it with a probability of 1 in 10**19.
    """
    spark = docs.sparkSession
    found = materialize(sketches(docs), "sketches")
    known = found.where("set_key is not null and doc_id is not null")
    first = F.min(F.struct(F.col("doc_id").alias("least"), "text_key", "chars", "bands")).alias("first")
    reps = known.groupBy("set_key").agg(F.count("*").alias("copies"), first).select("set_key", "copies", "first.*")
    # several sets may have the same least doc_id, so each has a number of its own, fixed once it is written
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    placed = materialize(buckets(reps), "candidates").join(reps.select("rep", "copies", "least", "text_key"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    # rows may repeat: one of them has the text
    members = materialize(texts.join(placed, ["least", "text_key"]).groupBy("rep").agg(F.min(F.struct("text", "own", "copies")).alias("m")).select("rep", "m.*"), "members")
    # a block holds about as many rows as an even share of a task has
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(LEAST_BLOCK, min(MOST_BLOCK, members.count() // max(1, partitions)))
    blocks = F.greatest(F.ceil(F.col("size") / per_block), F.ceil(F.col("sum") / BLOCK_CHARS)).cast("int")
    spread = members.select("rep", "text", "copies", F.col("own.key").alias("all"), F.explode("own").alias("b")).select("rep", "text", "copies", "all", "b.*").withColumn("blocks", blocks)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k"), "earlier": F.filter("all", lambda other: other < F.col("key"))})
    compared = materialize(compare(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")), "compared")
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(compared.select(F.col("rep").alias("a"), F.col("other").alias("b"))).toDF("rep", "component")
    numbered = materialize(classes.join(reps.select("rep", "least", "text_key"), "rep"), "classes")
    heads = numbered.groupBy("component").agg(F.min(F.struct("least", "text_key")).alias("head"))
    classes = numbered.join(heads, "component").select("rep", "head")
    result = reps.join(links, "rep", "left").join(classes, "rep", "left")
    own = F.struct("least", "text_key")
    # the look-up reads it three times, so it is written first, which keeps the driver's plan short
    result = result.select("set_key", F.col("copies").alias("n"), F.coalesce("head", own).alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    result = materialize(result, "results")
    # what has no words or no id is no part of a class of others, and isn't looked up
    others = found.where("set_key is null or doc_id is null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_text"), F.lit(0).cast("long").alias("n_links"))
    return look_up(known, result, "set_key", found.count()).select("doc_id", "text_key", F.col("head.least").alias("class_id"), F.col("head.text_key").alias("class_text"), "n_links").unionByName(others)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, of each class, whatever else its rows have.

    It is the one with the least doc_id; where texts of one class share that, the text with the least hash stays, and of
    rows with the same id and text the one whose other columns have the least hash. So near copies under one doc_id
    leave one row, texts of different classes under one doc_id a row each. Rows without a doc_id, which have no class, all stay.
    """
    others = _classes(docs).where("class_id <> doc_id or class_text <> text_key").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": text_key(), "__row": F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())})
    plain = [c for c in docs.columns if c not in ("doc_id", "text")]
    # equal ids with equal texts leave one row, whose other columns have the least hash; the keys of the join come first,
    # so texts are dealt out once
    rest = F.struct(F.xxhash64(F.to_json(F.struct(*plain))).alias("h"), F.to_json(F.struct(*plain)).alias("j")) if plain else F.lit(0)
    kept = rows.join(others, ["__id", "__key"], "left_anti").groupBy("__id", "__key", "doc_id", "text", "__row").agg(F.min_by(F.struct(*plain) if plain else F.lit(0), rest).alias("__rest"))
    return kept.select(*((F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c)) for c in docs.columns))

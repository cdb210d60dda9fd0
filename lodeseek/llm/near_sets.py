"""Near copies by sets of word shingles: fingerprints and min-hash bands find candidates, exact similarities decide.

Fingerprints within a few bits, through the vantage-point trees, reach only the closest of such pairs: at a Jaccard similarity of 0.8
a 64-bit fingerprint differs by about ten bits, which no tree prunes. So texts also meet in bands: a text's BANDS keys are
each made of WIDTH minima of its shingles under different hashes, and two texts with similarity s share
a band with probability 1 - (1 - s**WIDTH)**BANDS, 0.998 at 0.8. In a band's bucket texts are compared with its leaders by
one byte of each minimum; a text that is far from all leaders is one itself. These loose links only make groups, within
which simhash.leaders() compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import group_bounds, per_batch, quoted, signed, texts, written
from lodeseek.llm.components import components
from lodeseek.llm.simhash import KEPT_ID, KEPT_KEY, fingerprints, leaders, near_links, shingle_set, shingle_sets

SIMILARITY, WORDS = 0.8, 5
BANDS, WIDTH = 16, 5
#: Share of equal minima from which a text joins a leader's group.
LOOSE = 0.45
#: Parts in which a bucket's texts meet leaders of their own, before these leaders meet.
PARTS = 8
#: Bits of the fingerprints' links.
BITS = 2
_ODD = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * WIDTH), np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of BANDS * WIDTH hashes; zeros for no shingle."""
    if not len(shingles):
        return np.zeros(BANDS * WIDTH, np.uint64)
    out = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 11):
        part = shingles[at : at + (1 << 11), None] ^ _ODD[1]
        part *= _ODD[0]
        part ^= part >> np.uint64(32)
        out = np.minimum(out, (part * _ODD[1]).min(0))
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(key, n, bands array<long>, bytes binary) of docs(key, text): the band keys and a byte of each minimum."""
    place = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = np.array([minima(shingle_set(t, words)) for t in texts(batch)], np.uint64).reshape(-1, BANDS, WIDTH)
        keys = np.broadcast_to(place, low.shape[:2]).copy()
        for k in range(WIDTH):
            keys = (keys ^ low[:, :, k]) * _ODD[0, 0]
            keys ^= keys >> np.uint64(29)
        short = (low.reshape(len(low), -1) & np.uint64(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(signed(keys)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())], names=["key", "bands", "bytes"])

    return per_batch(docs.select("key", "text"), run, "key long, bands array<long>, bytes binary")


def _led(rows: DataFrame) -> DataFrame:
    """(a, b, band, bytes) of rows(band, part, key, bytes) dealt by band and part: a link a-b of a text with a leader, or, with a null, b as a leader.

    Rows pass one by one; what is held is the leaders of one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held, n = None, np.empty(0, np.int64), np.empty((0, BANDS * WIDTH), np.uint8), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            band, part, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "part", "key"))
            own = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, BANDS * WIDTH)
            a, b, new = [], [], []
            bounds = group_bounds(band, part)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if (band[x], part[x]) != at:
                    at, n = (band[x], part[x]), 0
                for i in range(x, y):
                    near = np.flatnonzero((held[:n] == own[i]).mean(1) >= LOOSE) if n else ()
                    if len(near):
                        a += names[near].tolist()
                        b += [int(key[i])] * len(near)
                        continue
                    if n == len(names):
                        names, held = np.resize(names, max(16, 2 * n)), np.resize(held, (max(16, 2 * n), BANDS * WIDTH))
                    names[n], held[n], n = key[i], own[i], n + 1
                    new.append(i)
            none = pa.nulls(len(new), pa.int64())
            columns = [pa.concat_arrays([pa.array(a, pa.int64()), none]), pa.array([*b, *key[new].tolist()], pa.int64()), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(band[new])]), pa.array([None] * len(a) + [own[i].tobytes() for i in new], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "band", "bytes"])

    dealt = rows.repartition("band", "part").sortWithinPartitions("band", "part", "key")
    return dealt.mapInArrow(run, "a long, b long, band long, bytes binary")


def band_links(own: DataFrame) -> DataFrame:
    """Links (a, b) between keys of sketches() that share a band and have LOOSE or more of their minima in common, as far as they go through leaders."""
    rows = own.select(F.explode("bands").alias("band"), F.pmod("key", F.lit(PARTS)).alias("part"), "key", "bytes")
    first = written(_led(rows), "led")
    heads = first.where("a IS NULL").select("band", F.lit(0).cast("long").alias("part"), F.col("b").alias("key"), "bytes")
    met = Window.partitionBy("band")
    second = written(_led(heads.withColumn("n", F.count("*").over(met)).where("n > 1").drop("n")), "led")
    return first.unionByName(second).where("a IS NOT NULL").select("a", "b")


def fingerprint_links(different: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between keys of different(key, text) whose fingerprints differ by BITS at most, directly or through others."""
    prints = written(fingerprints(different.select(F.col("key").alias("doc_id"), "text"), words), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    edges = near_links(points.select("fp"), BITS)
    of = lambda c: points.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return between.unionByName(prints.join(points, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs without the documents whose set of word shingles has `similarity` or more to one that stays and comes before it.

    Order is by doc_id, then by a hash of the text. A text of fewer words is one shingle; texts without words, null among them, are
    equal to each other. Rows with equal texts are one document, of which the first stays. Rows without doc_id stay.
    Texts may be of any length. Columns are those of docs, whatever their names, and an empty table gives an empty one.
    """
    text, key = F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))
    own = docs.where("doc_id IS NOT NULL").select("doc_id", key.alias("key"), text.alias("text"))
    firsts = written(own.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "firsts")
    named = written(own.join(firsts, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]), "texts")
    links = band_links(written(sketches(named, words), "sketches")).unionByName(fingerprint_links(named, words))
    groups = written(components(links), "groups")
    columns = ("component", "doc_id", "text_key", "fp")
    several = named.join(groups.withColumnRenamed("node", "key"), "key").select(F.col("root").alias("component"), "doc_id", F.col("key").alias("text_key"), F.lit(0).cast("long").alias("fp"), "text")
    members = written(shingle_sets(several, words, columns), "members")
    alone = firsts.join(groups.select(F.col("node").alias("key")), "key", "left_anti").select("doc_id", F.col("key").alias("text_key"))
    kept = written(alone.unionByName(leaders(members, 64, similarity)), "kept").toDF(KEPT_ID, KEPT_KEY)
    row = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").alias(KEPT_ID), key.alias(KEPT_KEY))
    found = row.join(kept, [KEPT_ID, KEPT_KEY], "left_semi")
    twice = own.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(KEPT_ID), F.col("key").alias(KEPT_KEY))
    twice = written(twice.join(kept, [KEPT_ID, KEPT_KEY], "left_semi"), "repeated")
    if not twice.isEmpty():
        again = found.join(twice, [KEPT_ID, KEPT_KEY], "left_semi").dropDuplicates([KEPT_ID, KEPT_KEY])
        found = found.join(twice, [KEPT_ID, KEPT_KEY], "left_anti").unionByName(again)
    rows = found.select("row").unionByName(row.where(F.col(KEPT_ID).isNull()).select("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

"""Near duplicates by SimHash: fingerprints are compared tile by tile with exclusive-or and bit counts; tiles whose population counts differ beyond the radius never meet."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_staged, released, slices, spans, staged, utf8
from .neardup import components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a tile: two tiles of 8 kB each meet in one comparison of a million pairs.
TILE = 1024
#: A tile holds fingerprints of equal population counts in each of so many parts of the 64 bits; more parts for more fingerprints (at least so many), so that tiles stay few-membered.
#: Every choice finds the same links: the counts of two fingerprints differ by RADIUS at most, summed over the parts.
PARTS = ((0, 4), (1 << 24, 8), (1 << 31, 16))

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LANES = np.uint64(0x0001000100010001)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of data. Spans under 32 bytes, nearly all, are hashed together by lanes of eight, four and one bytes; longer ones by the library, one by one."""
    n = end - start
    out = np.empty(len(n), np.uint64)
    long = np.flatnonzero(n >= 32)
    if len(long):
        raw = data.tobytes()
        out[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    few = np.flatnonzero(n < 32)
    at, n = start[few], n[few]
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", room.data, 0, (1,))
    four = np.ndarray(len(data) + 1, "<u4", room.data, 0, (1,))
    h = (n.astype(np.uint64) + np.uint64(seed)) + _P5
    for k in range(3):
        i = np.flatnonzero(n >= 8 * (k + 1))
        lane = _turn(eight[at[i] + 8 * k] * _P2, 31) * _P1
        h[i] = _turn(h[i] ^ lane, 27) * _P1 + _P4
    i = np.flatnonzero(n & 4)
    h[i] = _turn(h[i] ^ (four[at[i] + (n[i] & ~7)].astype(np.uint64) * _P1), 23) * _P2 + _P3
    for k in range(3):
        i = np.flatnonzero((n & 3) > k)
        h[i] = _turn(h[i] ^ (room[at[i] + (n[i] & ~3) + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[few] = h ^ (h >> np.uint64(32))
    return out


def add_bits(ones: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Count each bit of h into ones (rows by 64); owner, ascending, is the row of each hash."""
    # four counters of 16 bits are added at a time, over pieces of 65,535 hashes at most
    piece = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, np.arange(0, len(h), 65535)]))
    rows = owner[piece]
    for shift in range(16):
        sums = np.add.reduceat((h >> np.uint64(shift)) & _LANES, piece)
        for lane in range(4):
            ones[:, shift + 16 * lane] += np.bincount(rows, (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), len(ones)).astype(np.int64)


def prints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: A-Z lower-cased, words split at ASCII white space, shingles of WORDS words joined by spaces, repeats counted."""
    data = LOWER[data]
    start, end, row = spans(data, off)
    rows = len(off) - 1
    if not len(start):
        return np.zeros(rows, np.uint64)
    # words with one space after each
    length = end - start
    to = np.cumsum(length + 1)
    own = np.full(to[-1], 32, np.uint8)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    own[place] = data[place + np.repeat(start - (to - length - 1), length)]
    start, end = to - length - 1, to - 1
    n = np.bincount(row, minlength=rows)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    after = np.cumsum(n)[row]
    # a shingle begins at each word that has WORDS - 1 after it, or is its row's first
    at = np.flatnonzero((np.arange(len(row)) + WORDS <= after) | (np.arange(len(row)) == after - n[row]))
    ones = np.zeros((rows, 64), np.int64)
    for k in range(0, len(at), 1 << 18):
        some = at[k : k + (1 << 18)]
        add_bits(ones, hashes(own, start[some], end[np.minimum(some + WORDS, after[some]) - 1]), row[some])
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints(*utf8(part.column(1))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over links a to b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)  # a label falls with those that carry it
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links between two tiles (right None: within one) do, at most one for each fingerprint; however many
    pairs are within the radius, a dense tile pair gives no more."""
    other = left if right is None else right
    a, b = [], []
    for at in range(0, len(left), 256):
        i, j = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ other[None, :]) <= radius)
        a.append(i + at)
        b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    both = left if right is None else np.concatenate([left, right])
    if right is not None:
        b = b + len(left)
    root = forest(len(both), a, b)
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[moved], both[root[moved]]


def offsets(parts: int, radius: int = RADIUS) -> list[list[int]]:
    """Differences of counts, for each part, whose absolute sum is at most radius; of two that are opposite, one; the zero difference first."""
    out = [[0] * parts]
    for n in range(1, radius + 1):
        for where in itertools.combinations_with_replacement(range(parts), n):
            k = sorted(set(where))
            for signs in itertools.product((1, -1), repeat=len(k) - 1):
                of = dict(zip(k, (1, *signs), strict=True))
                out.append([of.get(p, 0) * where.count(p) for p in range(parts)])
    return out


def tiles_of(found: DataFrame, parts: int) -> DataFrame:
    """counts (population counts of the parts), tile, fps: the distinct fingerprints of found (fp) in tiles of about TILE."""
    width = 64 // parts
    mask = F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")
    keyed = found.select("fp", F.array(*[F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(mask)) for k in range(parts)]).alias("counts"))
    sizes = keyed.groupBy("counts").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = keyed.join(sizes, "counts").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    return dealt.groupBy("counts", "tile").agg(F.collect_list("fp").alias("fps"))


def links(found: DataFrame, parts: int) -> DataFrame:
    """a, b: links that connect the distinct fingerprints of found (fp) as all pairs within RADIUS do.

    Which tiles meet is told by their counts alone; their fingerprints follow for the pairs of tiles that do.
    """
    tiles = staged(tiles_of(found, parts), "tiles")
    index = tiles.select("counts", "tile")
    shifts = F.posexplode(F.lit(offsets(parts))).alias("step", "shift")
    probes = index.select(F.col("counts").alias("c0"), F.col("tile").alias("t0"), shifts).withColumn("counts", F.zip_with("c0", "shift", lambda x, y: x + y))
    met = index.join(probes, "counts").where("step > 0 OR tile <= t0")
    left = met.join(tiles.select(F.col("counts").alias("c0"), F.col("tile").alias("t0"), F.col("fps").alias("left")), ["c0", "t0"])
    both = left.join(tiles.withColumnRenamed("fps", "right"), ["counts", "tile"])
    pairs = both.select(F.when((F.col("step") > 0) | (F.col("tile") != F.col("t0")), F.col("right")).alias("right"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for right, left in zip(batch.column(0), batch.column(1), strict=True):
                other = right.values.to_numpy(zero_copy_only=False).view(np.uint64) if right.is_valid else None
                a, b = compare(left.values.to_numpy(zero_copy_only=False).view(np.uint64), other)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    out = staged(pairs.mapInArrow(released(run), "a long, b long"), "links")
    drop_staged(tiles)
    return out


def parts_for(n: int) -> int:
    return [p for least, p in PARTS if n >= least][-1]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row of docs (doc_id, text; other columns are not read).

    Rows of equal fingerprints are one from the start, so copies make no pairs. Null and empty texts, and texts without words, have fingerprint zero and are linked like any other;
    a text of fewer than WORDS words is one shingle. Repeated rows get equal results; rows of one doc_id with different texts are each linked by their own text. A null doc_id names no
    class: component_id is then the least other one, or null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = staged(fingerprints(docs), "fingerprints")
    found = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(found.select("fp"), parts_for(found.count()))
    roots = components(edges)
    rooted = staged(found.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents whose fingerprints differ in two bits or fewer."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""N-gram Jaccard join by vertical partitioning.

Documents are sets of hashed word n-grams under one global order, rare n-grams first. The order is
cut at pivots into fragments; the overlap of a pair is counted in each fragment separately and the
partial counts are summed per pair. Candidates come from the rare end of that order (the prefix that
any two linked sets must share an n-gram of).

Equal sets are one class from the start. Classes with the same commonest prefix n-gram sit in one
tile, of a bounded number of classes and n-grams; a class also visits each other tile that holds a
candidate for it. A task counts one tile's overlaps, portion by portion and fragment after fragment, and leaves out what
can't reach the threshold any more. It returns a row for each class (its number of links and one
linked class), never a row for each pair, so a group of near copies costs rows in proportion to its
size (times the tiles it fills), while every candidate pair is held against the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, mix, rows, stored, table, text_chunks
from .graph import components

#: Counters of the frequency sketch (a fixed 32 MB), and the pieces it travels in, compressed.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Bits of the filter of classes that have a candidate (a fixed 2 MB), and its pieces.
FILTER_BITS, FILTER_PARTS = 24, 64
#: An n-gram that the sketch counts this much oftener than a mean one is dealt out by its classes, too, in so many parts.
COMMON, PARTS = 4096, 64
#: Classes and n-grams that are counted at a time. A family that fills many such blocks is cut into tiles of up to SIDE of them
#: either way, as many as the root of its blocks, so a class travels that often and not once a block.
TILE_CLASSES, TILE_GRAMS, SIDE = 1000, 1 << 20, 4
#: An n-gram of so many sets in a task is counted by matrix products, so many at a time.
DENSE, COLUMNS = 32, 2048

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents that stand one after the other in data."""
    word = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, n: int) -> list[np.ndarray]:
    """For each document its sorted distinct n-word shingles as uint64; a shorter one is one shingle."""
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    starts, ends = word_bounds(data, offsets)
    words = rolling.slices(_LOWER[data], starts, ends)
    first = np.searchsorted(starts, offsets)  # of each document, and the end
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        if len(words) > k:
            total[: len(words) - k] += words[k:] * _PLACES[k]
    total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a sorted set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def _sketching(n: int):
    schema = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, sketch = Rolling(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_chunks(batch, 1):
                sets = shingle_sets(data, offsets, rolling, n)
                if any(map(len, sets)):
                    slots = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    np.add.at(sketch, slots, 1)
                none = [None] * len(sets)
                yield rows(schema, ids[lo:hi], [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets], none, none)
        if sketch.any():
            none = [None] * SKETCH_PARTS
            yield rows(schema, none, none, none, range(SKETCH_PARTS), [_packed(x) for x in np.split(sketch, SKETCH_PARTS)])

    return run


def _packed(counts: np.ndarray) -> bytes:
    """A byte for the width of the counts, and the counts, compressed."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if counts.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + pa.compress(counts.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = (1 << SKETCH_BITS) // SKETCH_PARTS
    return np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd", asbytes=True), f"i{data[0]}").astype(np.int64)


def _summed(groups):
    return groups.applyInArrow(lambda t: pa.table({"part": t.column("part")[:1], "counts": pa.array([_packed(sum(_unpacked(x.as_py()) for x in t.column("counts")))], pa.binary())}), "part int, counts binary")


@dataclass
class Order:
    """The global order: by the sketch's count, then by the n-gram's hash; cut at pivots (counts)."""

    counts: np.ndarray
    pivots: np.ndarray
    common: float

    @classmethod
    def of(cls, counts: np.ndarray, fragments: int) -> Order:
        held = np.sort(counts[counts > 0])
        mass = np.cumsum(held)
        at = [int(np.searchsorted(mass, mass[-1] * k / fragments)) for k in range(1, fragments)] if len(held) else []
        return cls(counts, np.unique(held[at]) if len(held) else np.zeros(0, np.int64), COMMON + 2 * counts.mean())

    def count(self, s: np.ndarray) -> np.ndarray:
        return self.counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in the global order, with each n-gram's fragment."""
        c = self.count(s)
        order = np.lexsort((s, c))
        return s[order], np.searchsorted(self.pivots, c[order], "right")


def _prefixes(n: int, num: int, den: int, order):
    schema = pa.schema([("token", pa.int64()), ("part", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = Rolling(), set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, 0):
                tokens, cids, sizes, places = [], [], [], []
                for s in shingle_sets(data, offsets, rolling, n):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    own = order.value.sort(s)[0][: prefix_length(len(s), num, den)]
                    tokens.append(own)
                    cids.append(np.full(len(own), key))
                    sizes.append(np.full(len(own), len(s), np.int32))
                    places.append(np.arange(len(own), dtype=np.int32))
                if tokens:
                    token, cid = np.concatenate(tokens), np.concatenate(cids)
                    part = np.where(order.value.count(token) > order.value.common, 1 + cid % PARTS, 0)
                    yield rows(schema, token.view(np.int64), part.astype(np.int32), cid, np.concatenate(sizes), np.concatenate(places))

    return run


def _segments(n: int, fragments: int, order, wanted):
    schema = pa.schema([("cid", pa.int64()), ("grams", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = Rolling(), set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, 0):
                out: tuple[list, list, list] = ([], [], [])
                for s in shingle_sets(data, offsets, rolling, n):
                    if not len(s) or (key := set_key(s)) in seen or not wanted.value[(key & ((1 << FILTER_BITS) - 1)) >> 3] >> (key & 7) & 1:
                        continue
                    seen.add(key)
                    grams, fragment = order.value.sort(s)
                    out[0].append(key)
                    out[1].append(grams.view(np.int64))
                    out[2].append(np.searchsorted(fragment, np.arange(fragments), "right").astype(np.int32))
                if out[0]:
                    yield rows(schema, *out)

    return run


def _filter(spark: SparkSession, cids: DataFrame):
    """A bitmap of fixed size with a bit for each cid."""
    bit = F.col("cid").bitwiseAND((1 << FILTER_BITS) - 1)
    width = (1 << FILTER_BITS) // FILTER_PARTS

    def fold(t: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        bits[t.column("bit").to_numpy() % width] = 1
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = cids.select(bit.alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / width).cast("int")).groupBy("part").applyInArrow(fold, "part int, bits binary").collect()
    out = np.zeros((FILTER_PARTS, width // 8), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


@dataclass
class NgramJoin:
    """documents: (id, n_shingles, class_id, n_links, component_id). links: (a, b, overlap, n_a, n_b) of
    linked class pairs that hold each component together."""

    documents: DataFrame
    links: DataFrame


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100, fragments: int = 8) -> NgramJoin:
    """Links documents whose n-gram sets have a Jaccard similarity of num/den or more.

    Words are runs of other bytes than space and U+0009..U+000D, with A-Z lower-cased. A text with
    fewer than n words is one n-gram; a null, empty or blank text has no n-gram, no class and no
    link, and is its own component. Repeated rows and repeated ids count as documents of their own;
    n_links is the number of other documents that one is linked with, its copies included;
    component_id is the smallest id in the component (null only if all its ids are null). Columns
    other than the two named are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    first = stored(source.mapInArrow(_sketching(n), "row_id long, n long, cid long, part int, counts binary"), "sets")
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    pieces = first.where("part is not null").select("part", F.spark_partition_id().alias("task"), "counts")
    for r in _summed(_summed(pieces.groupBy("part", F.col("task") % 64)).groupBy("part")).collect():
        sketch[r.part] = _unpacked(r.counts)
    order = spark.sparkContext.broadcast(Order.of(sketch.ravel(), fragments))
    sets = first.where("part is null").select("row_id", "n", "cid")

    text = source.select("text")
    blocks = stored(_blocks(text.mapInArrow(_prefixes(n, num, den, order), "token long, part int, cid long, n int, pos int"), num, den), "blocks")
    sizes = stored(sets.where("cid is not null").groupBy("cid").agg(F.min("row_id").alias("least_id"), F.count("*").alias("copies")), "classes")
    members = stored(_tiles(blocks).join(sizes.select("cid", "copies"), "cid"), "members")
    seats = stored(_seats(members, stored(_meetings(blocks, members, num, den), "meetings")), "seats")
    segments = text.mapInArrow(_segments(n, fragments, order, _filter(spark, seats)), "cid long, grams array<long>, ends array<int>")
    segments = segments.groupBy("cid").agg(F.first("grams").alias("grams"), F.first("ends").alias("ends"))  # copies in several tasks
    counted = seats.join(segments, "cid").groupBy("tile", "turn").applyInArrow(_count_tile(num, den, fragments), "cid long, links long, other long, overlap long, n int, n_other int")
    counted = stored(counted, "counted")

    links = counted.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"), "overlap", F.col("n").alias("n_a"), F.col("n_other").alias("n_b"))
    joined = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    beyond = counted.groupBy("cid").agg(F.sum("links").alias("beyond"))
    classes = stored(sizes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(beyond, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "classes")
    ids = classes.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(ids, "comp").select("cid", "least_id", "component_id", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    alone = F.col("cid").isNull()
    own = lambda c: F.when(alone, F.col("row_id")).otherwise(F.col(c))
    documents = sets.join(classes, "cid", "left").select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), own("least_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), own("component_id").alias("component_id"))
    return NgramJoin(documents, links)


def _blocks(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, cid, n, pos, held): prefix n-grams that several classes hold and a partner may be found by; held is about how many.

    Repeats of a class are dropped. At position pos a class has n - pos n-grams left to share, which
    is enough for partners up to some size; where the block's least class is above it, the row goes.
    The parts of a common n-gram don't see each other, so nothing of it goes.
    """
    key = ["token", "part"]
    rows_ = prefixes.withColumn("before", F.lag("cid").over(Window.partitionBy(*key).orderBy("cid"))).where("before is null or before <> cid").drop("before")
    block = Window.partitionBy(*key)
    rows_ = rows_.withColumns({"held": F.count("*").over(block), "least": F.min("n").over(block)})
    fits = f"{num + den} * cast(n - pos as bigint) >= {num} * cast(n + least as bigint)"
    return rows_.where(f"part > 0 or held > 1 and {fits}").select("token", "cid", "n", "pos", F.expr(f"if(part > 0, held * {PARTS}, held)").alias("held"))


def _tiles(blocks: DataFrame) -> DataFrame:
    """(cid, n, family, whole, tile, side): families are the classes with the same commonest prefix n-gram and about the same size.

    A large family fills tiles of its own (whole), small ones are dealt out to common tiles. Tiles
    hold about TILE_CLASSES classes and TILE_GRAMS n-grams at most, times side in large families, but
    for one class that is larger.
    """
    home = blocks.groupBy("cid").agg(F.max_by("token", F.struct("held", "token")).alias("home"), F.first("n").alias("n"))
    size = F.floor(F.log("n") / math.log(4 / 3))
    home = stored(home.select("cid", "n", F.xxhash64("home", size).alias("family")), "homes")
    kin = home.groupBy("family").agg(F.greatest(F.count("*") / TILE_CLASSES, F.sum("n") / TILE_GRAMS).alias("fill"))
    side = F.when(F.col("fill") > 0.25, F.least(F.ceil(F.sqrt("fill")), F.lit(SIDE)))
    kin = stored(kin.withColumn("side", side).withColumn("parts", F.ceil(F.col("fill") / F.col("side"))), "families")
    shared = max(1, math.ceil(kin.where("parts is null").agg(F.sum("fill")).first()[0] or 0))
    own = F.xxhash64("family", F.pmod(F.xxhash64("cid"), F.col("parts")))
    tile = F.coalesce(own, F.pmod("family", F.lit(shared)))
    return home.join(kin, "family").select("cid", "n", "family", F.col("parts").isNotNull().alias("whole"), tile.alias("tile"), F.coalesce("side", F.lit(1)).alias("side"))


def _meetings(blocks: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, own, family, tile, home): a class meets the families, its own (home) and those of a higher rank, that may hold a partner of it.

    Families in whole tiles rank higher. A family cut into tiles counts as one for each tile.
    """
    large = lambda c: f"cast({c} as bigint)"
    seat = F.struct("whole", "tile", "family").alias("seat")
    placed = stored(blocks.join(members.select("cid", "whole", "tile", "family"), "cid").select("token", "cid", "n", "pos", seat), "placed")
    hosts = placed.groupBy("token", "seat").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("left"), F.count("*").alias("many"))
    hosts = hosts.withColumnRenamed("seat", "host")
    fits = f"{den} * {large('most')} >= {num} * {large('n')} and {den} * {large('n')} >= {num} * {large('least')} and {num + den} * {large('least(n - pos, left)')} >= {num} * {large('n + least')}"
    met = placed.join(hosts, "token").where(f"(seat < host or seat = host and many > 1) and {fits}")
    return met.select("cid", F.col("seat.tile").alias("own"), F.col("host.family").alias("family"), F.col("host.tile").alias("tile"), F.expr("seat = host").alias("home")).distinct()


def _seats(members: DataFrame, meetings: DataFrame) -> DataFrame:
    """(tile, turn, cid, n, copies, visitor): every tile's members that someone is to meet, once for each turn of its visitors."""
    visits = meetings.where("tile <> own").select("cid", "tile").distinct()
    visitors = visits.join(members.select("cid", "n", "copies"), "cid")
    room = members.groupBy("tile").agg(F.max("side").alias("side"))
    turns = visitors.groupBy("tile").agg(F.greatest(F.count("*") / TILE_CLASSES, F.sum("n") / TILE_GRAMS).alias("fill"))
    turns = turns.join(room, "tile").select("tile", F.ceil(F.col("fill") / F.col("side")).alias("turns"))
    visitors = visitors.join(turns, "tile").select("tile", F.pmod(F.xxhash64("cid"), F.col("turns")).alias("turn"), "cid", "n", "copies", F.lit(True).alias("visitor"))
    guests = meetings.select("cid").distinct().withColumn("guest", F.lit(True))
    hosts = meetings.where("not home").select("family").distinct().withColumn("host", F.lit(True))
    wanted = members.join(guests, "cid", "left").join(hosts, "family", "left").where("guest or host")
    crowd = wanted.groupBy("tile").agg(F.count("*").alias("crowd")).join(turns, "tile", "left").where("crowd > 1 or turns > 0")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("turns", F.lit(1)) - 1))
    hosts = wanted.join(crowd, "tile").select("tile", turn.alias("turn"), "cid", "n", "copies", F.lit(False).alias("visitor"))
    return hosts.unionByName(visitors)


def add_overlaps(total: np.ndarray, ids: np.ndarray, owners: np.ndarray, split: int = 0) -> None:
    """Adds to total[i, j], i <> j, the number of ids that owners i and j have in common. An owner has an id once.

    With a split, only owners before it are held against those from it on.
    """
    size = len(total)
    ids = np.unique(ids, return_inverse=True)[1]
    held = np.bincount(ids)
    dense = np.flatnonzero(held >= DENSE)
    column = np.full(len(held), -1)
    column[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), COLUMNS):
        at = column[ids]
        pick = (at >= lo) & (at < lo + COLUMNS)
        has = np.zeros((size, min(COLUMNS, len(dense) - lo)), np.float32)
        has[owners[pick], at[pick] - lo] = 1
        if split:
            cross = (has[:split] @ has[split:].T).astype(total.dtype)
            total[:split, split:] += cross
            total[split:, :split] += cross.T
        else:
            total += (has @ has.T).astype(total.dtype)
    pick = (held[ids] > 1) & (column[ids] < 0)
    ids, owners = ids[pick], owners[pick]
    turn = np.argsort(ids, kind="stable")
    ids, owners = ids[turn], owners[turn]
    for k in range(1, DENSE):
        if len(ids) <= k:
            break
        same = ids[k:] == ids[:-k]
        if not same.any():
            break
        a, b = owners[:-k][same], owners[k:][same]
        if split:
            apart = (a < split) != (b < split)
            a, b = a[apart], b[apart]
        np.add.at(total, (a, b), 1)
        np.add.at(total, (b, a), 1)


def tile_overlaps(grams: np.ndarray, ends: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, num: int, den: int, split: int = 0) -> np.ndarray:
    """The overlaps of a tile's sets; where allowed and enough for a link they are whole.

    grams are the sets one after the other, in the global order; ends (sets x fragments) are the
    fragments' ends in each. A set without a pair that can still reach the threshold is left out of
    the later fragments. With a split, only sets before it meet those from it on.
    """
    count = len(sizes)
    owners = np.repeat(np.arange(count), sizes)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros((count, count), np.int64 if len(sizes) and sizes.max() > 1 << 22 else np.int32)
    need = num * (sizes[:, None] + sizes[None, :]).astype(total.dtype)
    alive, before = allowed.any(1), np.zeros(count, np.int64)
    for end in ends.T:
        here = alive[owners] & (place >= before[owners]) & (place < end[owners])
        if here.any():
            add_overlaps(total, grams[here], owners[here], split)
        before = end
        left = (sizes - end).astype(total.dtype)
        alive = (allowed & ((num + den) * (total + np.minimum(left[:, None], left[None, :])) >= need)).any(1)
        if not alive.any():
            break
    return np.where(allowed & alive[:, None] & alive[None, :] & ((num + den) * total >= need), total, 0)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each node another one that it is linked with, so that these links alone connect what all links do; -1 for roots."""
    parent = np.full(len(linked), -1)
    fresh = linked.any(1)
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root], ahead = False, [root]
        while ahead:
            k = ahead.pop()
            found = np.flatnonzero(linked[k] & fresh)
            parent[found], fresh[found] = k, False
            ahead += found.tolist()
    return parent


class Forest:
    """Keeps of the links given those that connect what was not connected yet."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))
        self.near: list[list[tuple[int, int]]] = [[] for _ in range(size)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def add(self, a: int, b: int, overlap: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.near[a].append((b, overlap))
            self.near[b].append((a, overlap))

    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node the next one towards the least of its tree (-1: it is that), and the overlap with it."""
        parent, overlap = np.full(len(self.up), -1), np.zeros(len(self.up), np.int64)
        ahead = [k for k in range(len(self.up)) if self.root(k) == k]
        while ahead:
            k = ahead.pop()
            for other, o in self.near[k]:
                if other != parent[k]:
                    parent[other], overlap[other] = k, o
                    ahead.append(other)
        return parent, overlap


def _portions(sizes: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen sets in portions of about TILE_CLASSES sets and TILE_GRAMS n-grams."""
    if not len(chosen):
        return []
    fill = np.maximum(np.arange(len(chosen)) / TILE_CLASSES, (np.cumsum(sizes[chosen]) - sizes[chosen]) / TILE_GRAMS)
    return np.split(chosen, np.flatnonzero(np.diff(fill.astype(int))) + 1)


def _count_tile(num: int, den: int, fragments: int):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("overlap", pa.int64()), ("n", pa.int32()), ("n_other", pa.int32())])

    def run(key, t):
        t = t.combine_chunks()
        cid, sizes, copies = (t.column(c).to_numpy().astype(np.int64) for c in ("cid", "n", "copies"))
        visitor = np.array(t.column("visitor").to_pylist(), bool)
        grams, ends = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("grams", "ends"))
        ends, start = ends.reshape(-1, fragments), np.cumsum(sizes) - sizes
        hosts, guests = _portions(sizes, np.flatnonzero(~visitor)), _portions(sizes, np.flatnonzero(visitor))
        if len(hosts) + len(guests) <= 2:  # at once
            turns = [(np.concatenate([*hosts, *guests]), 0)]
        else:
            first = key[1].as_py() == 0  # where the hosts meet each other; the guests never do
            turns = [(a, 0) for a in hosts if first] + [(np.concatenate((a, b)), len(a)) for k, a in enumerate(hosts) for b in [*hosts[k + 1 :] * first, *guests]]
        links, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
        for own, split in turns:
            size, guest = sizes[own], visitor[own]
            allowed = ~(guest[:, None] & guest[None, :])
            if key[1].as_py():
                allowed &= guest[:, None] | guest[None, :]
            if split:
                allowed[:split, :split] = allowed[split:, split:] = False
            np.fill_diagonal(allowed, False)
            allowed &= den * np.minimum(size[:, None], size[None, :]) >= num * np.maximum(size[:, None], size[None, :])
            place = np.repeat(start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            overlap = tile_overlaps(grams[place], ends[own], size, allowed, num, den, split)
            linked = overlap > 0
            links[own] += linked @ copies[own]
            up = spanning(linked)
            for k in np.flatnonzero(up >= 0).tolist():
                forest.add(int(own[k]), int(own[up[k]]), int(overlap[k, up[k]]))
        parent, shared = forest.parents()
        some = np.flatnonzero(links)
        up = parent[some]
        none = up < 0
        masked = lambda x: pa.array(x, mask=none)
        return pa.Table.from_arrays([pa.array(cid[some]), pa.array(links[some]), masked(cid[up]), masked(shared[some]), pa.array(sizes[some].astype(np.int32)), masked(sizes[up].astype(np.int32))], schema=schema)

    return run


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).documents.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")

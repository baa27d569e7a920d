"""Near duplicates: an exact Jaccard join of word shingles by parity sketches.

Sketches. A token set is dealt into blocks by its tokens' hashes, and a block's
sketch is the XOR of its tokens' hashes: a token in one of two sets but not in
the other changes one block, so no more blocks differ than the sets' symmetric
difference has tokens. The same holds for bits where each token flips one bit.

Bands. Sizes lie in bands that grow by half. Sets that link at `percent` differ
in at most d = (100 - percent) / (100 + percent) * (a + b) tokens; in the scheme
of the larger one's band there are more blocks than the d of its largest sizes,
so some block that holds a token is equal in both (pigeonhole). A set gives its
blocks in its own band's scheme and, if a larger partner can lie in the next
band, in that one's. A set with too few blocks that hold a token (so that the
rule could rest on an empty block) gives its empty ones too.

Candidates. Blocks go packed, 6 bytes each, to the task of their hash; equal
ones of different sets make a bucket. In a bucket of more than FREQUENT sets
(a common passage, a large group of near copies), a set is left out if it has
more unaffected blocks than it lies in such buckets: then it meets each of its
partners in another bucket too. Sets that lack this slack are split to the end,
one token a block: of two linked sets the rarest tokens (counted among these
sets) of each, as many as they may differ in and one, share a token. So members
of a large group whose own changes already fill that number meet nobody.
Pairs whose bits differ in more places than the sets may are dropped, and what
is left is verified on the whole sets.

Components. First each bucket's sets are tested against one of them (all pairs
in small ones; STARS buckets a set where it lacks slack), then those not yet
joined against SLOTS sets of each bucket, where they lack slack; then, exactly,
all pairs of a bucket whose sets are still not joined. So a large group of near
copies costs a few tests a member, and no link between two groups is lost. Equal
sets are one class from the start.

Scale: token sets never leave their task but for classes in candidate pairs;
nothing of the corpus goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, bounded_batches, by_bytes, discard, join_hot, materialise, ragged, shuffle_parts
from .components import components
from .shingles import SLICE_BYTES, mix, shingle_sets

#: Sets in a bucket from which it counts as frequent.
FREQUENT = 32
#: Sets in a bucket up to which the first pass tests all pairs.
SMALL = 4
#: Buckets in which the first pass tests a set that lacks slack.
STARS = 12
#: Sets of a bucket that the second pass compares with all others there, where they lack slack.
SLOTS = 16
#: Ratio of the size classes of sets that lack slack.
CLASS = 1.05
#: Bits that a join of sets that lack slack compares before it makes a pair.
JOIN_BITS = 1024
#: Rows of ids and hashes up to which a table is broadcast.
BROADCAST_ROWS = 500_000
#: Longest bit sketch, in bits.
MOST_BITS = 8192
#: Texts in a slice, so that twice their number fits in the 16 bits of a packed block's owner.
SLICE_TEXTS = 1 << 15
PART_ROWS = "kind int, part int, id long, text_key long, n long, gid long, class binary, bits binary, slack0 int, slack1 int, blocks binary, members array<long>"


class Bands:
    """The size bands and their schemes for one threshold; all follow from percent, so every task has the same."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
        self.bounds = np.array(bounds, np.int64)
        self.blocks = np.ones(len(bounds) - 1, np.int64)
        for j in range(len(bounds) - 1):
            most = bounds[j + 1] - 1
            d = self.differ(most, most)
            if d:
                least = max(1, bounds[j] * percent // 100)
                m = d + 1
                while m < 4 * d + 4 and m * (1 - (1 - 1 / m) ** least) < 1.08 * (d + 1) + 2:
                    m += max(1, m // 64)
                self.blocks[j] = m

    def differ(self, a, b):
        """Most tokens in which linked sets of sizes a and b differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return 100 * n // self.percent


def bit_sketch(h: np.ndarray, n: int) -> bytes:
    """A bit for each of 64 .. MOST_BITS places: set if an odd number of tokens fall on it; more places are always folded to fewer by XOR of halves."""
    size = min(MOST_BITS, max(64, 1 << int(2 * n - 1).bit_length())) if n else 64
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def fixed_sketch(h: np.ndarray) -> list[int]:
    """The same on JOIN_BITS places whatever the size, as longs."""
    odd = np.bincount((h & np.uint64(JOIN_BITS - 1)).astype(np.int64), minlength=JOIN_BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def bits_differ(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _class(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def block_sketches(h: np.ndarray, n: np.ndarray, scheme: np.ndarray, bands: Bands, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets of ascending hashes (one after another, n each), each in its scheme: (hash of each block given, its set, slack of each set).

    slack: blocks with tokens beyond those that partners up to `partner` can
    differ in, less one; negative where empty blocks are given too.
    """
    m = bands.blocks[scheme]
    text = np.repeat(np.arange(len(n)), n)
    block = ((h >> np.uint64(32)) * m[text].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    xor = np.bitwise_xor.reduceat(h, at) if len(at) else h[:0]
    who, block = text[at], block[at].astype(np.int64)
    filled = np.bincount(who, minlength=len(n))
    most = np.minimum(bands.bounds[scheme + 1] - 1, partner)
    slack = filled - 1 - np.minimum(bands.differ(n, most), m - 1)
    poor = np.flatnonzero((slack < 0) & (n > 0))
    if len(poor):
        every = ragged(np.zeros(len(poor), np.int64), m[poor])
        whose = np.repeat(poor, m[poor])
        missing = ~np.isin(whose * (1 << 33) + every, who * (1 << 33) + block)
        who, block = np.concatenate([who, whose[missing]]), np.concatenate([block, every[missing]])
        xor = np.concatenate([xor, np.zeros(int(missing.sum()), np.uint64)])
    place = (scheme[who] << np.int64(40)) + block
    return mix(xor + mix(place.astype(np.uint64) + np.uint64(1))), who, slack


_COLUMNS = [("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("gid", pa.int64()), ("class", pa.binary()), ("bits", pa.binary()), ("slack0", pa.int32()), ("slack1", pa.int32()), ("blocks", pa.binary()), ("members", pa.list_(pa.int64()))]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])


def _sketch(bands: Bands, parts: int):
    """Text rows to rows of kind 0 (a text: id, n, class, the gid of the first of its class in the slice, which also has bits and slacks) and 1 (packed blocks for a part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("parity_join")
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for some in by_bytes(batch, "text", SLICE_BYTES, SLICE_TEXTS):
                h, n = shingle_sets(some.column("text"))
                ends = np.cumsum(n)
                classes = [_class(h[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                first: dict[bytes, int] = {}
                for k, c in enumerate(classes):
                    first.setdefault(c, k)
                own = np.array([k for k in sorted(first.values()) if n[k]], np.int64)
                gid = np.full(len(n), -1, np.int64)
                gid[own] = number + np.arange(len(own))
                gid = np.where(n > 0, gid[[first[c] for c in classes]], -1)
                sub, size = h[ragged((ends - n)[own], n[own])], n[own]
                scheme, partner = bands.of(size), bands.largest_partner(size)
                sig, who, slack0 = block_sketches(sub, size, scheme, bands, partner)
                two = np.flatnonzero(bands.of(partner) > scheme)
                sig2, who2, slack2 = block_sketches(h[ragged((ends - n)[own[two]], size[two])], size[two], scheme[two] + 1, bands, partner[two])
                slack1 = np.zeros(len(own), np.int64)
                slack1[two] = slack2
                value, owner = np.concatenate([sig, sig2]), np.concatenate([who * 2, two[who2] * 2 + 1])
                part = ((value >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part.astype(np.uint32), kind="stable")
                packed = np.empty(len(value), [("sig", "<u4"), ("who", "<u2")])
                packed["sig"], packed["who"] = (value & np.uint64(0xFFFFFFFF))[order], owner[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                there = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                sketches: list[bytes | None] = [None] * len(n)
                slacks = [[None] * len(n), [None] * len(n)]
                for k, at in enumerate(own.tolist()):
                    sketches[at] = bit_sketch(h[ends[at] - n[at] : ends[at]], int(n[at]))
                    slacks[0][at], slacks[1][at] = int(slack0[k]), int(slack1[k])
                yield _batch(len(n), kind=np.zeros(len(n), np.int32), part=np.arange(len(n)) % parts, id=some.column("id"), text_key=some.column("text_key"), n=n, gid=pa.array(gid, mask=gid < 0), **{"class": classes}, bits=sketches, slack0=slacks[0], slack1=slacks[1])
                if there:
                    yield _batch(len(there), kind=np.ones(len(there), np.int32), part=there, gid=np.full(len(there), number), blocks=[packed[cuts[p] : cuts[p + 1]].tobytes() for p in there])
                number += len(own)

    return run


def _buckets(part: pa.Table) -> pa.Table:
    """A part's blocks to buckets: kind 2 (small: all members, each distinct set of members once), 3 (frequent: a row a member, n its role)."""
    kinds = part.column("kind").to_numpy()
    rows = part.filter(pa.array(kinds == 1))
    out = [part.filter(pa.array(kinds == 0)).select([c for c, _ in _COLUMNS])]
    blobs = [np.frombuffer(x, [("sig", "<u4"), ("who", "<u2")]) for x in rows.column("blocks").to_pylist()]
    if not blobs:
        return out[0]
    sig = np.concatenate([b["sig"] for b in blobs])
    gid = np.concatenate([b["who"].astype(np.int64) for b in blobs]) + 2 * np.repeat(rows.column("gid").to_numpy(), list(map(len, blobs)))
    order = np.argsort(sig, kind="stable")
    sig, gid = sig[order], gid[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(sig)))
    some = (size > 1) & (size <= FREQUENT)
    start2, size2 = start[some], size[some]
    if len(start2):
        members = gid[ragged(start2, size2)] >> 1
        key = mix(np.add.reduceat(mix(members.astype(np.uint64)), np.cumsum(size2) - size2) + size2.astype(np.uint64))
        _, one = np.unique(key, return_index=True)
        members = gid[ragged(start2[one], size2[one])] >> 1
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size2[one])]).astype(np.int32), members)
        out.append(pa.Table.from_batches([_batch(len(one), kind=np.full(len(one), 2, np.int32), gid=key[one].view(np.int64), members=lists)]))
    many = size > FREQUENT
    if many.any():
        members = gid[ragged(start[many], size[many])]
        bucket = np.repeat(mix(sig[start[many]].astype(np.uint64) + (np.uint64(part.column("part")[0].as_py()) << np.uint64(32))).view(np.int64), size[many])
        out.append(pa.Table.from_batches([_batch(len(members), kind=np.full(len(members), 3, np.int32), id=members >> 1, n=members & 1, gid=bucket)]))
    return pa.concat_tables(out)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, hashes, bits) of the classes in wanted (class, id): their texts are read and cut again; bits: fixed_sketch."""
    ids = wanted.select(F.col("id").alias("wanted")).distinct()
    rows = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "text", SLICE_BYTES):
                h, n = shingle_sets(some.column("text"))
                ends = np.cumsum(n)
                sets = [h[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), h.view(np.int64)), pa.array([fixed_sketch(x) for x in sets], pa.list_(pa.int64()))], ["class", "hashes", "bits"])

    return rows.mapInArrow(run, "class binary, hashes array<long>, bits array<long>").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _verify(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, bands: Bands) -> DataFrame:
    """Those of the pairs (u, v) of vertices that link."""
    side = {s: vertices.select(F.col("gid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "uv"}
    share = F.lit(bands.percent)
    sized = pairs.join(side["u"], "u").join(side["v"], "v").filter((F.col("n_u") * 100 >= F.col("n_v") * share) & (F.col("n_v") * 100 >= F.col("n_u") * share))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b, x, y = (batch.column(c).to_pylist() for c in ("u", "v", "n_u", "n_v", "bits_u", "bits_v"))
            keep = [k for k in range(len(u)) if bits_differ(x[k], y[k]) <= bands.differ(a[k], b[k])]
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    close = materialise(sized.mapInArrow(near, "u long, v long"), "close-pairs")
    ends = close.select(F.col("u").alias("gid")).union(close.select("v")).distinct()
    wanted = materialise(vertices.join(ends, "gid", "left_semi").select("gid", "class", "id"), "wanted")
    sets = materialise(_sets(docs, wanted).join(wanted.select("class", "gid"), "class").select("gid", "hashes"), "sets")
    full = close.join(sets.select(F.col("gid").alias("u"), F.col("hashes").alias("x")), "u").join(sets.select(F.col("gid").alias("v"), F.col("hashes").alias("y")), "v")

    both = F.size(F.array_intersect("x", "y"))
    meet = F.lit(100) * both >= share * (F.size("x") + F.size("y") - both)
    links = materialise(full.filter(meet).select("u", "v"), "links")
    discard(close, wanted, sets)
    return links


def _rarest(docs: DataFrame, poor: DataFrame, bands: Bands) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, probe, sketches): rows (b, v, n) of the sets in poor, of which linked ones, the smaller in index and the larger in probe, share a b; and (v, bits).

    Tokens are ordered by how many of these sets hold them, rarest first. Linked
    sets of sizes a <= b share at least percent / (100 + percent) * (a + b)
    tokens, so the first n - that + 1 of each share one: for the index with b = a,
    for the probe by size class of a. Tokens of one set only keep their places in
    the order but need no row.
    """

    t = bands.percent
    sets = materialise(_sets(docs, poor).join(poor.select("class", "gid"), "class").select("gid", "hashes", "bits"), "poor-sets")
    tokens = materialise(sets.select(F.explode("hashes").alias("token"), F.col("gid").alias("v"), F.size("hashes").cast("long").alias("n")), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("v")
    ranked = tokens.join(counts, "token").withColumn("rank", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")))
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS))).cast("int")
    share = lambda total: F.ceil(total * t / (100 + t) - 1e-9)
    least = F.ceil(F.col("n") * t / 100 - 1e-9)
    ranked = materialise(ranked.filter(F.col("rank") <= F.col("n") - least + 1).select("token", "v", "n", "rank"), "ranked")
    index = ranked.filter(F.col("rank") <= F.col("n") - share(2 * F.col("n")) + 1).withColumn("size", size_class(F.col("n")))
    probe = ranked.withColumn("size", F.explode(F.sequence(size_class(least), size_class(F.col("n")))))
    low = F.greatest(least, F.floor(F.pow(F.lit(CLASS), F.col("size"))) - 1)
    probe = probe.filter(F.col("rank") <= F.col("n") - share(F.col("n") + low) + 1)
    prefixes = [materialise(x.select(F.xxhash64("token", "size").alias("b"), "v", "n"), "prefixes") for x in (index, probe)]
    discard(tokens, ranked)
    return *prefixes, sets.select(F.col("gid").alias("v"), "bits")


def _classified(df: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, c, component) of each row: xxhash64 of its text, size of its set, a number for its component (null without words) and the component's least id."""
    spark = df.sparkSession
    bounded_batches(spark)
    bands, parts = Bands(percent), max(64, 4 * shuffle_parts(spark))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sketch(bands, parts), PART_ROWS)
    found = materialise(sketched.groupBy("part").applyInArrow(_buckets, PART_ROWS), "buckets")
    rows = found.filter("kind = 0").select("id", "text_key", "n", F.col("gid").alias("own"), "class", "bits", "slack0", "slack1")

    # a vertex for each class: the least gid that any slice gave it
    firsts = rows.filter("bits is not null").drop("text_key")
    heads = materialise(firsts.groupBy("class").agg(F.min("own").alias("gid"), F.count("*").alias("slices")), "heads")
    vertices = join_hot(firsts, heads, "class", "slices").withColumn("bits", F.when(F.col("own") == F.col("gid"), F.col("bits")))
    vertices = materialise(vertices, "vertices")
    to = vertices.select(F.col("own").alias("m"), F.col("gid").alias("v"))
    vertex = vertices.filter("own = gid").drop("own")

    small = found.filter("kind = 2").select(F.col("gid").alias("b"), "members").dropDuplicates(["b"]).select("b", F.explode("members").alias("m"))
    small = small.join(to, "m").select("b", "v")
    buckets = materialise(small.distinct(), "members")
    frequent = found.filter("kind = 3").select(F.col("gid").alias("b"), F.col("id").alias("m"), F.col("n").alias("role")).join(to, "m").select("b", "v", "role").distinct()
    hot = frequent.groupBy("v", "role").agg(F.count("*").alias("hot"))
    lacks = F.col("hot") > F.when(F.col("role") == 0, F.col("slack0")).otherwise(F.col("slack1"))
    poor = materialise(hot.join(vertex.withColumnRenamed("gid", "v"), "v").filter(lacks).select(F.col("v").alias("gid"), "class", "id").distinct(), "poor")
    rarest = None if poor.isEmpty() else _rarest(docs, poor, bands)

    heads_of = buckets.groupBy("b").agg(F.min("v").alias("u"), F.count("*").alias("k")).filter("k > 1")
    stars = buckets.join(heads_of, "b").filter("u < v").select("u", "v")
    few = buckets.join(heads_of.filter(f"k > 2 and k <= {SMALL}").select("b"), "b", "left_semi")
    tested = stars.union(few.select("b", F.col("v").alias("u")).join(few, "b").filter("u < v").select("u", "v"))
    if rarest:
        index, probe, _ = rarest
        centres = index.groupBy("b").agg(F.min_by("v", F.xxhash64("v", "b")).alias("u"))
        drawn = Window.partitionBy("v").orderBy(F.xxhash64("b", "v"), "b")
        tested = tested.union(probe.join(centres, "b").filter("u <> v").withColumn("draw", F.row_number().over(drawn)).filter(f"draw <= {STARS}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    tested = materialise(tested.distinct(), "pairs")
    links = _verify(tested, vertex, docs, bands)

    # what is left: pairs of a bucket that are not joined yet
    label = components(links)

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(label, "v", "left").withColumn("c", F.coalesce("c", "v"))

    def live(members: DataFrame) -> DataFrame:
        return members.groupBy("b").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("b")

    def crossing(slots: int | None = None) -> DataFrame:
        """Pairs (u, v) of sets that lack slack, of different components, near by their bits: all, or those with one set of each slot of a bucket."""
        index, probe, fold = rarest
        held, asked = materialise(labelled(index), "joined"), materialise(labelled(probe), "joined")
        alive = materialise(live(held.union(asked)), "live")
        own = held.join(alive, "b", "left_semi")
        if slots:
            slot = F.pmod(F.xxhash64("v", "b"), F.lit(slots)).alias("slot")
            own = own.groupBy("b", slot).agg(F.min_by(F.struct("v", "n", "c"), F.xxhash64("b", "v")).alias("one")).select("b", "one.*")
        own = own.select("b", F.col("v").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu")).join(fold.select(F.col("v").alias("u"), F.col("bits").alias("x")), "u")
        other = asked.join(alive, "b", "left_semi").join(fold, "v")
        apart = F.aggregate(F.zip_with("x", "bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
        may = F.lit(100 - percent) * (F.col("nu") + F.col("n")) >= F.lit(100 + percent) * apart
        pairs = own.join(other, "b").filter("cu <> c and struct(nu, u) < struct(n, v)").filter(may).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = materialise(pairs.distinct(), "crossing")
        discard(held, asked, alive)
        return pairs

    now = materialise(labelled(buckets), "joined")
    left = materialise(now.join(live(now), "b", "left_semi"), "live")
    rest = left.select("b", F.col("v").alias("u"), F.col("c").alias("cu")).join(left, "b").filter("u < v and cu <> c").select("u", "v")
    drawn = [crossing(SLOTS)] if rarest else []
    steps = [lambda: reduce(DataFrame.union, drawn, rest)]
    if rarest:  # then, exactly, what these have not joined
        steps.append(crossing)
    for step in steps:
        more = materialise(step().distinct().join(tested, ["u", "v"], "left_anti"), "rest")
        if more.isEmpty():
            continue
        before, links = links, materialise(links.union(_verify(more, vertex, docs, bands)), "links")
        before_tested, tested = tested, materialise(tested.union(more), "pairs")
        discard(before, before_tested, more)
        label = components(links)
    discard(*drawn, now, left, tested, buckets, poor, links, *(rarest or ()))

    # from vertices to classes of slices to rows
    least = rows.filter("n > 0").groupBy(F.col("own").alias("m")).agg(F.min("id").alias("least"))
    by_vertex = least.join(to, "m").groupBy("v").agg(F.min("least").alias("least"))
    by_vertex = materialise(by_vertex.join(label, "v", "left").select("v", F.coalesce("c", "v").alias("c"), "least"), "classes")
    groups = materialise(by_vertex.groupBy("c").agg(F.min("least").alias("component"), F.count("*").alias("size")), "groups")
    answer = join_hot(by_vertex, groups, "c", "size").select("v", "c", "component").join(heads.select(F.col("gid").alias("v"), "slices"), "v")
    answer = materialise(answer, "answer")
    told = materialise(join_hot(to, answer, "v", "slices").select(F.col("m").alias("own"), "c", "component"), "told")
    discard(vertices, heads, by_vertex, groups, answer, label)
    worded = rows.filter("n > 0").select("id", "text_key", "n", "own").join(told, "own").select("id", "text_key", "n", "c", "component")
    return worded.union(rows.filter("n = 0").select("id", "text_key", "n", F.lit(None).cast("long"), "id"))


def near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of each row.

    Rows link if 100 * shared shingles >= percent * shingles in either (percent
    over 50); component_id is the least id that links lead to, itself included.
    A text without words (null, empty, white space) links with nothing, not even
    with its like. Repeated rows link as copies; rows with a null id link and
    count, but give no component its id, and one whose component has no other
    id gets null. An empty table gives an empty result.
    """
    found = _classified(df, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all columns: of each component one, with its least id (null last), of these the one whose text has the least hash, and of rows that repeat id and text one.

    Rows without words all stay. Ids of rows to drop are broadcast if they are
    counted to be at most BROADCAST_ROWS (16 bytes each); beyond it the rows are
    joined.
    """
    found = materialise(_classified(df, percent, id_col, text_col).filter("n > 0").select("id", "text_key", "c"), "components")
    least = found.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_key").alias("key"))).alias("best"), F.count("*").alias("size"))
    placed = join_hot(found, materialise(least, "survivors"), "c", "size")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.key"))
    key = [F.col("id").alias("__id"), F.col("text_key").alias("__key")]
    counted = materialise(placed.groupBy(*key, stays.alias("stays")).agg(F.count("*").alias("n")).filter("not stays or n > 1"), "decided")
    on = lambda rows, with_: rows[id_col].cast("long").eqNullSafe(with_["__id"]) & (F.xxhash64(rows[text_col].cast("string")) == with_["__key"])
    drop, twice = (counted.filter(c).select("__id", "__key") for c in ("not stays", "stays"))
    if counted.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    kept = df.join(drop, on(df, drop), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, on(kept, twice), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, on(kept, twice), "left_anti").unionAll(again)

"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Documents are compared as sets of word shingles. Two sets with Jaccard
similarity t or more have sizes within a factor t and differ in at most
(a + b)(1 - t)/(1 + t) shingles. So sizes are cut into bands; within a band
every set is dealt into m parts by shingle hash, m larger than the number of
differences k two similar sets of that band can have. At least m - k parts
are then equal in both: documents meet in the tile (band, part, content).
Parts that hold few shingles are left out where enough others remain, so a
passage that many documents share does not fill a tile by itself.

In a tile, each member is compared with the tile's first one; members that
are then still in different components are compared with each other, in
blocks. Of the pairs found so, a forest is verified first and joins their
components, so that a large group of near copies gives no more pairs than
members; all pairs between components that still differ come last. A
comparison first bounds the overlap from above by parity bitmaps (each
differing shingle can flip one bit, so the overlap is at most
(a + b - differing bits)/2), and only then intersects the sorted arrays.

Equal sets are one node (64-bit digest of the set), so copies cost nothing.

Links between different sets stand within components only. To count them all,
the sets of a component are dealt into blocks, and each pair of blocks
intersects its sets exactly; only counts for each set leave the task.
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.common import staged, text_or_empty
from skylane.llm.graph import components

RATIO = 1.4             # sizes of one band
PART_FILL = 0.85        # shingles per part, as a share of the most that the threshold allows
BLOCK = 4096            # members of a tile that are compared with each other in one task
BLOCK_SHINGLES = 1 << 20        # shingles of a block whose links are counted in one task
SCREEN = 128            # most 64-bit words of a folded bitmap
KEYS_HELD = 64          # tiles of a set that its rows carry along
ROUNDS = 3              # passes over the tiles with forests, before one with all pairs that are left
CHUNK = 1 << 22         # bytes of text hashed at a time

_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _C[0])
_POW = np.cumprod(np.concatenate(([_U(1)], np.full((1 << 16) - 1, _C[1]))), dtype=np.uint64)
_WHITE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run without ASCII white space, A-Z lower-cased)."""
    if len(raw) > 2 * CHUNK:
        hs, ss, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            while end < len(raw) and not _WHITE[raw[end]]:
                end += 1
            h, s = word_hashes(raw[at:end]) if end - at <= 2 * CHUNK else _hash_words(raw[at:end])
            hs.append(h)
            ss.append(s + at)
            at = end
        return np.concatenate(hs), np.concatenate(ss)
    return _hash_words(raw)


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.arange(starts[0], len(data))
    place = at - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = (_BYTE[data[starts[0]:]] + (place >> 16).astype(np.uint64) * _C[4]) * _POW[place & 0xFFFF]
    value[~inside[starts[0]:]] = 0
    return _mix(np.add.reduceat(value, starts - starts[0])), starts


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes."""
    out, at = [], 0
    while at < len(texts):
        raws, size, end = [], 0, at
        while end < len(texts) and (end == at or size < CHUNK):
            raws.append((texts[end] or "").encode("utf-8", "surrogatepass"))
            size += len(raws[-1])
            end += 1
        begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
        h, starts = word_hashes(b" ".join(raws))
        first = np.searchsorted(starts, begin)
        w = _mix(h + _C[5])
        grams = w[:max(0, len(w) - k + 1)] * _C[0]
        for j in range(1, k):
            grams = grams + w[j:len(w) - k + 1 + j] * _U((int(_C[j % 5]) + 2 * j) & (2**64 - 1))
        grams = _mix(grams)
        for d in range(len(raws)):
            lo, hi = int(first[d]), int(first[d + 1])
            if hi - lo >= k:
                g = np.sort(grams[lo:hi - k + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif hi > lo:
                few = sum((int(x) * int(_C[j % 5]) for j, x in enumerate(w[lo:hi])), (hi - lo) * int(_C[4])) & (2**64 - 1)
                out.append(_mix(np.array([few], dtype=np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out


class Scheme:
    """Bands, parts and bounds for Jaccard similarity num/den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        most = num / (den - num)                # shingles per possible difference, at equal sizes
        self.fill = max(1.0, PART_FILL * most)
        self.lows, low = [], 1
        while low < 1 << 40:
            self.lows.append(low)
            low = max(low + 1, math.ceil(low * RATIO))
        self.bands = [self._band(lo, hi - 1) for lo, hi in zip(self.lows, [*self.lows[1:], 1 << 41], strict=True)]
        # parts with at most this many shingles are weak
        lam, share, self.weak, term = self.fill / RATIO, 1 - PART_FILL, -1, math.exp(-self.fill / RATIO)
        total = 0.0
        while total + term < 0.75 * share:
            total += term
            self.weak += 1
            term *= lam / (self.weak + 1)

    def _band(self, low: int, high: int) -> tuple[int, int]:
        """Most differences of two sets, the smaller one in the band; number of parts."""
        k = (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return k, (1 if k == 0 else max(k + 1, math.ceil(high / self.fill)))

    def band(self, n: int) -> int:
        return bisect.bisect_right(self.lows, n) - 1

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Tile keys (48 bits) of a set: in its own band and in those of smaller similar sets."""
        n, out = len(s), []
        content = _mix(s ^ _C[3])
        for i in range(self.band(-(-n * self.num // self.den)), self.band(n) + 1):
            k, m = self.bands[i]
            part = (s % _U(m)).astype(np.int64)
            acc = np.zeros(m, np.uint64)
            np.add.at(acc, part, content)
            count = np.bincount(part, minlength=m)
            strong = count > self.weak
            use = np.flatnonzero(strong) if (m - int(strong.sum())) < m - k else np.arange(m)
            out.append(_mix(acc[use] * _C[1] + use.astype(np.uint64) * _C[0] + _U((i + 1) * int(_C[2]) & (2**64 - 1))) >> _U(16))
        return np.unique(np.concatenate(out)).astype(np.int64)

    def bitmap(self, s: np.ndarray) -> bytes:
        """Parity bitmap: bit h mod length flips with each shingle; length a power of two near the set size."""
        size = 1 << max(8, (len(s) - 1).bit_length())
        odd = np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size) & 1
        return np.packbits(odd.astype(bool), bitorder="little").tobytes()

    def may_link(self, a: int, b: int, differing: int) -> bool:
        return self.links(a, b, (a + b - differing) // 2)

    def links(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    return x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded, which keeps parities."""
    size = min(len(x), len(y)) // 8
    a, b = (_fold(np.frombuffer(z, np.uint64), size) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def _digest(s: np.ndarray) -> int:
    return int((_mix(s + _C[1]).sum(dtype=np.uint64) ^ _U(len(s) * 0x9E3779B9)).astype(np.int64)) if len(s) else 0


def _signatures(k: int, scheme: Scheme):
    """doc_id, n, node of every document; bits and keys with the first one of each set in the task."""
    def run(batches):
        seen: set[int] = {0}
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), k)
            nodes = [_digest(s) for s in sets]
            new = [here and x not in seen and not seen.add(x) for x, here in zip(nodes, b.column("doc_id").is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                                              pa.array([scheme.bitmap(s) if y else None for s, y in zip(sets, new, strict=True)], pa.binary()),
                                              pa.array([scheme.keys(s) if y else None for s, y in zip(sets, new, strict=True)], pa.list_(pa.int64()))],
                                             ["doc_id", "n", "node", "bits", "keys"])
    return run


def _sets(k: int):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            rows = [(x, s) for s in shingle_sets(b.column("text").to_pylist(), k) if len(s) and (x := _digest(s)) not in seen and not seen.add(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))], ["node", "shingles"])
    return run


def _filter_bits(scheme: Scheme):
    def run(batches):
        for b in batches:
            c = [b.column(x).to_pylist() for x in ("an", "abits", "bn", "bbits")]
            ok = [scheme.may_link(an, bn, differing_bits(x, y)) for an, x, bn, y in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _count_links(scheme: Scheme):
    """node, links: copies of the other sets of one block pair that a set links with; rows come sorted by block pair."""
    num, den = scheme.num, scheme.den

    def counts(rows):
        rows = sorted(rows, key=lambda r: (r[1], len(r[3])))
        n, side, copies = (np.array(x, dtype=np.int64) for x in ([len(r[3]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        ends = np.cumsum(n)
        flat, ids = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        out, split = np.zeros(len(rows), np.int64), int(np.searchsorted(side, 2))
        mark = np.zeros(len(flat), np.int8)
        for i in range(len(rows) - 1 if split == len(rows) else split):
            first = i + 1 if side[i] == 0 else split            # the other side; sizes rise within a side
            lo = first + int(np.searchsorted(n[first:] * den, num * n[i]))
            hi = first + int(np.searchsorted(n[first:] * num, den * n[i], side="right"))
            if lo >= hi:
                continue
            mine, at = ids[ends[i] - n[i]:ends[i]], ends[lo] - n[lo]
            mark[mine] = 1
            common = np.add.reduceat(mark[ids[at:ends[hi - 1]]], ends[lo:hi] - n[lo:hi] - at, dtype=np.int64)
            mark[mine] = 0
            hit = np.flatnonzero(den * common >= num * (n[i] + n[lo:hi] - common)) + lo
            out[i] += copies[hit].sum()
            out[hit] += copies[i]
        at = np.flatnonzero(out)
        return pa.RecordBatch.from_arrays([pa.array([rows[j][0] for j in at], pa.int64()), pa.array(out[at], pa.int64())], ["node", "links"])

    def run(batches):
        block, rows = None, []
        for b in batches:
            for at, (root, t1, t2, node, side, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "t1", "t2", "node", "side", "copies")), strict=True)):
                if (root, t1, t2) != block:
                    if len(rows) > 1:
                        yield counts(rows)
                    block, rows = (root, t1, t2), []
                rows.append((node, side, copies, b.column("shingles")[at].values.to_numpy().view(np.uint64)))
        if len(rows) > 1:
            yield counts(rows)
    return run


def _filter_exact(scheme: Scheme):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                u, v = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                ok.append(scheme.links(len(u), len(v), len(np.intersect1d(u, v, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _tile_pairs(scheme: Scheme, forest: bool):
    """Pairs of one tile block, in different components, that the bitmaps allow; rows come sorted by tile.

    A pair that meets in several tiles comes from the smallest of them only
    where both rows hold their tiles (``keys``); pairs of others, that lie in
    more than ``KEYS_HELD`` tiles, are told apart later.

    Bitmaps folded to one length screen a row against all that follow at a
    time; pairs that pass are held against their full bitmaps. As a
    ``forest``, a pair joins the components of its rows within the block, so
    that there are fewer pairs than rows; the likeliest come first, from any
    tile.
    """
    num, den = scheme.num, scheme.den

    def pairs(rows, tile):
        node, n, comp, side = (np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 1, 3, 4))
        bits = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = min(SCREEN, *(len(b) for b in bits))
        screen, out = np.stack([_fold(b, size) for b in bits]), []
        for i in range(len(rows) - 1):
            m, s = n[i + 1:], side[i + 1:]
            ok = (comp[i + 1:] != comp[i]) & (node[i + 1:] != node[i]) & ((s != side[i]) | (s == 0))
            at = np.flatnonzero(ok & (den * np.minimum(m, n[i]) >= num * np.maximum(m, n[i]))) + i + 1
            if not len(at):
                continue
            total = n[at] + n[i]
            common = (total - np.bitwise_count(screen[at] ^ screen[i]).sum(axis=1, dtype=np.int64)) // 2
            fits = den * common >= num * (total - common)
            at, rank = at[fits], (common / total)[fits]
            for j in at[np.argsort(-rank, kind="stable")] if forest else at:
                if rows[i][5] and rows[j][5] and min(rows[i][5] & rows[j][5]) != tile:
                    continue
                if comp[i] != comp[j] and scheme.may_link(int(n[i]), int(n[j]), differing_bits(rows[i][2], rows[j][2])):
                    out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
                    if forest:
                        comp[comp == comp[j]] = comp[i]
        return out

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    def run(batches):
        tile, rows = None, []
        for b in batches:
            columns = ("key", "t1", "t2", "node", "n", "bits", "comp", "side", "keys")
            for key, t1, t2, node, n, bits, comp, side, keys in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if (key, t1, t2) != tile:
                    if len(rows) > 1:
                        yield emit(pairs(rows, tile[0]))
                    tile, rows = (key, t1, t2), []
                rows.append((node, n, bits, comp, side, keys and set(keys)))
        if len(rows) > 1:
            yield emit(pairs(rows, tile[0]))
    return run


PAIRS = "a long, b long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, prof: DataFrame, k: int, scheme: Scheme, name: str, kept: list[DataFrame]) -> DataFrame | None:
    """The pairs (a, b) whose sets, intersected as sorted arrays, reach the threshold; None without pairs.

    Their sets (node, shingles) are added to ``kept``."""
    pairs = staged(pairs, f"{name}-candidates")
    if name == "rest" and pairs.isEmpty():
        return None
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # one document of each set gives its shingles
    reps = prof.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(nodes, "node", "left_semi")
    full = texts.join(reps.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("text")
    sets = staged(full.mapInArrow(_sets(k), "node long, shingles array<long>").join(nodes, "node", "left_semi"), f"{name}-sets")
    kept.append(sets)
    sets = sets.dropDuplicates(["node"])
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y"))
    return staged(both.mapInArrow(_filter_exact(scheme), PAIRS), f"{name}-links")


def similarity_links(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles: doc_id, n, node; links: a, b between nodes that connect all similar sets; node, root).

    The links are verified ones and as many as connect every component: a
    pair that others already connect may be missing (``link_counts`` counts
    those as well)."""
    return _similarity(docs, k, num, den, id_col, text_col)[:3]


def _similarity(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """The same, and the tables of sets (node, shingles) that hold all linked nodes."""
    kept: list[DataFrame] = []
    scheme, texts = Scheme(num, den), _texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("n", "long").add("node", "long")
    sig = staged(texts.mapInArrow(_signatures(k, scheme), schema.add("bits", "binary").add("keys", T.ArrayType(T.LongType()))), "signatures")
    prof, sig = sig.select("doc_id", "n", "node"), sig.where("keys is not null")
    rows = sig.select("node", F.explode("keys").alias("key"))
    # staged by itself, so that its shuffle is off the disk before the next begins
    shared = staged(rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a"), "shared-tiles")
    tiles = staged(rows.join(shared, "key").where("node > a").select("key", "a", "node").distinct(), "tiles")
    bits = sig.select("node", "n", "bits").dropDuplicates(["node"])

    # each member against the first of its tile
    star = tiles.select("a", F.col("node").alias("b")).distinct()
    star = (star.join(bits.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits")), "b")
            .join(bits.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits")), "a")
            .select("a", "an", "abits", "b", "bn", "bbits").mapInArrow(_filter_bits(scheme), PAIRS))
    links = _verified(star, texts, prof, k, scheme, "star", kept)

    # tiles with members in several components: the members against each other
    comp, found = staged(components(links), "star-components"), [links]
    for forest in [True] * ROUNDS + [False]:
        more = _verified(_across(tiles, comp, bits, scheme, forest), texts, prof, k, scheme, "rest", kept)
        if more is None:
            break
        if more.isEmpty():
            if forest:                          # some candidates are left, and which of them link is not known yet
                more = _verified(_across(tiles, comp, bits, scheme, False), texts, prof, k, scheme, "rest", kept)
                found.append(more)
                comp = _merged(comp, more)
            break
        found.append(more)
        comp = _merged(comp, more)
    return prof, reduce(DataFrame.unionByName, found), comp, kept


def link_counts(prof: DataFrame, comp: DataFrame, kept: list[DataFrame], num: int, den: int) -> DataFrame:
    """``node, links``: documents of other sets that each set links with, all pairs counted; sets without any are left out."""
    nodes = prof.where("n > 0 and doc_id is not null").groupBy("node").agg(F.first("n").alias("n"), F.countDistinct("doc_id").alias("copies"))
    members = staged(comp.join(nodes, "node").select("node", "root", "n", "copies"), "members")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = (members.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "node", "copies",
                     F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side")))
    sets = reduce(DataFrame.unionByName, kept).join(comp.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return (dealt.join(sets, "node").select("root", "t1", "t2", "node", "side", "copies", "shingles")
            .repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2")
            .mapInArrow(_count_links(Scheme(num, den)), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")))


def _across(tiles: DataFrame, comp: DataFrame, bits: DataFrame, scheme: Scheme, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of one tile in different components: all, or as a forest only."""
    members = (tiles.select("key", "node").unionByName(tiles.select("key", F.col("a").alias("node")).distinct())
               .join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")))
    mixed = (members.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.sum(F.xxhash64("node") % (1 << 40)).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
             .where("lo < hi and size > 2"))
    # similar texts share many tiles; of tiles with the same members one is enough
    mixed = mixed.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = (members.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "node", "comp",
                     F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side")))
    if forest:
        held = bits.withColumn("keys", F.lit(None).cast("array<long>"))
    else:       # a set lies in as many tiles as it has parts: thousands, if its text is long
        held = bits.join(dealt.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
        held = held.withColumn("keys", F.when(F.size("keys") <= KEYS_HELD, F.col("keys")))
    return (dealt.join(held, "node").select("key", "t1", "t2", "node", "n", "bits", "comp", "side", "keys")
            .repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").mapInArrow(_tile_pairs(scheme, forest), PAIRS).distinct())


def _merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after more links; only roots are joined anew."""
    roots = comp.select(F.col("node").alias("x"), F.col("root").alias("r"))
    up = (more.join(roots, F.col("a") == F.col("x"), "left").select(F.coalesce("r", "a").alias("a"), "b")
          .join(roots, F.col("b") == F.col("x"), "left").select("a", F.coalesce("r", "b").alias("b")))
    top = staged(components(up), "root-components")
    a, t = comp.alias("a"), top.select(F.col("node").alias("x"), F.col("root").alias("r")).alias("t")
    moved = a.join(t, F.col("a.root") == F.col("t.x"), "left").select("a.node", F.coalesce("t.r", "a.root").alias("root"))
    alone = top.join(comp, "node", "left_anti").select("node", "root")
    return staged(moved.unionByName(alone), "merged-components")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Sets link when intersection / union >= num/den; component_id is the
    smallest doc_id reachable by links, the document's own included.

    * a null or empty text, or one without words, has no shingles and links
      with nothing, not even with its like: component_id is its doc_id;
    * with fewer than k words the whole sequence is the one shingle;
    * rows that share a doc_id are versions of one document, in one class
      with whatever any version links to; rows without doc_id take no part
      (component_id null);
    * an empty table gives an empty result; other columns are ignored.
    """
    prof, _, comp, _ = _similarity(docs, k, num, den, id_col, text_col)
    return _classes(prof, comp).select("doc_id", "n_shingles", "component_id")


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``jaccard_components`` with the number of links: doc_id, n_shingles, component_id, n_links, n_equal.

    ``n_links`` counts the documents whose set is another one and links with
    the row's, every pair for itself; ``n_equal`` the other documents with an
    equal set. Both are 0 without shingles or without doc_id. A document that
    comes with several texts counts once for each different set."""
    prof, _, comp, kept = _similarity(docs, k, num, den, id_col, text_col)
    links = staged(link_counts(prof, comp, kept, num, den), "link-counts")
    copies = prof.where("n > 0 and doc_id is not null").groupBy("node").agg((F.countDistinct("doc_id") - 1).alias("equal")).where("equal > 0")
    out = _classes(prof, comp).join(links, "node", "left").join(copies, "node", "left")
    count = lambda c: F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return out.select("doc_id", "n_shingles", "component_id", count("links").alias("n_links"), count("equal").alias("n_equal"))


def _classes(prof: DataFrame, rooted: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every document."""
    sets = prof.where("n > 0 and doc_id is not null")
    same_id = sets.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    if not same_id.isEmpty():                   # ids that come with several texts
        first = same_id.select("doc_id", "a")
        versions = sets.join(first, "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct()
        rooted = components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(versions))
    classes = sets.groupBy("node").agg(F.min("doc_id").alias("least")).join(rooted, "node", "left")
    classes = classes.select("node", "least", F.coalesce("root", "node").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    out = prof.join(named, "node", "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "node")

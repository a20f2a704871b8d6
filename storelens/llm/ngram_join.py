"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed: every shingle flips the bits it hashes to, so what two
sets share cancels out and their sketches differ in no more places than their symmetric difference has
elements. For Jaccard t that difference is bounded by the sizes: d <= (a + b) (1 - t) / (1 + t), and
d <= a (1 - t) / t for the smaller size a. Sizes are dealt into bands; for pairs within a band, and for
pairs across a border of bands, a sketch is cut into more than k = max d blocks, each the XOR of the 64-bit
hashes of its shingles. A linked pair differs in k blocks at most (pigeonhole), so whatever the order of
blocks, the first that both share is among the k + 1 first of either. Blocks of many shingles come first:
unrelated documents that have a few shingles in common share blocks of one shingle, but hardly these, and
would else form one group that grows with the corpus. Shingles that very many documents share (found on a
sample) are left out of the blocks: that can only lessen differences.

Documents that share a block are candidates; their groups are the components of "shares a block". Within
a group all pairs, tile by tile, are held against the Hamming bound of parity sketches of about four bits
a shingle; the components of what passes are small and tight, and in them all pairs are held against the
exact sets. Pairs already connected are skipped, so a tile returns a forest and never all its pairs.

Sets are identified by 64-bit digests of their 64-bit shingle hashes; equal sets are one node from the
start, so copies cost one row each.

Defined results: words are runs of characters other than ASCII white space, after lower-casing A-Z;
with fewer words than a shingle, the sequence of all words is the only shingle; null, empty and blank
texts have the empty set and are linked with nothing; rows that share an id are separate documents; null
ids take part and lose against any id as the smallest; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import prepare, shuffle_partitions, whole, written
from storelens.llm.components import components

U = np.uint64
MAX_WORDS = 400_000
TILE = 2048
RANGE_BITS = 12
PACKED = 4096
RATIO = 2
ORDERED = 4  # blocks are ordered by their elements up to this number
WHOLE = 1 << 16  # added to the level of blocks that hold frequent shingles too
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS: dict[bytes, int] = {}  # hashes of words this task has met; idle workers hold none


def _mix(h: np.ndarray, factor: int, shift: int) -> np.ndarray:
    h = h * U(factor)
    return h ^ (h >> U(shift))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    found = (text or "").encode().translate(_LOWER).split()  # bytes split at exactly the six ASCII white spaces
    if not found:
        return np.empty(0, dtype=U)
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    hashes = []
    for w in found:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    a = np.array(hashes, dtype=U)
    m = min(width, len(a))
    with np.errstate(over="ignore"):
        h = np.full(len(a) - m + 1, m, dtype=U)
        for i in range(m):
            h = _mix(h + a[i : len(a) - m + 1 + i], 0x9E3779B97F4A7C15, 29)
        return np.unique(_mix(h, 0xBF58476D1CE4E5B9, 32))


class Bands:
    """Sizes in bands [lo, hi) of ratio ``RATIO``, for linked pairs of Jaccard ``t``."""

    def __init__(self, t: Fraction):
        self.t = t
        self.plans: dict[tuple[int, int], tuple[int, int]] = {}

    def levels(self, n: int) -> list[tuple[int, int, int]]:
        """(level, most, blocks) for every level at which a set of size n may meet a linked, unequal one, in ``most`` differences.

        Level 2i holds the pairs within band i, level 2i + 1 those across its upper border.
        """
        i, lo = 0, 1
        while lo * RATIO <= n:
            i, lo = i + 1, lo * RATIO
        apart, up = (1 - self.t) / (1 + self.t), int(n / self.t)
        out = [(2 * i, int(2 * (lo * RATIO - 1) * apart), lo, min(up, lo * RATIO - 1))]
        if up >= lo * RATIO:
            out.append((2 * i + 1, int((lo * RATIO - 1) * (1 - self.t) / self.t), math.ceil(lo * RATIO * self.t), up))
        if n * self.t <= lo - 1:
            out.append((2 * i - 1, int((lo - 1) * (1 - self.t) / self.t), math.ceil(lo * self.t), lo - 1))
        # so many blocks that even the smallest set of the level leaves, by chance, more than k of them not empty
        return [(level, int((n + largest) * apart), k + 4 + math.ceil(1.3 * (k + 1) * math.exp(-least / (k + 1)))) for level, k, least, largest in out if k > 0]


def _blocks(s: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR and number of the elements of every block."""
    where = ((s >> U(6)) % U(blocks)).astype(np.int64)
    x, order = np.zeros(blocks, dtype=U), np.argsort(where, kind="stable")
    first = np.flatnonzero(np.diff(where[order], prepend=-1))
    if len(first):
        x[where[order][first]] = np.bitwise_xor.reduceat(s[order], first)
    return x, np.bincount(where, minlength=blocks)


def signatures(s: np.ndarray, frequent: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of (level, block, XOR of the block's elements) that a linked set shares at least one of.

    Linked sets differ in ``most`` blocks at the most, so in any order of all blocks the first that they share is among
    the ``most`` + 1 first of each. Blocks of many elements come first, for few unrelated sets share them, those of one
    element late and empty blocks last. A set whose first blocks would be empty, as most of its shingles are frequent,
    hands in blocks with these instead; another such set does the same, and any other shares a block that is not empty.
    """
    out = []
    rare = s
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = s[frequent[at] != s]

    def hashed(elements: np.ndarray, level: int, most: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        x, n = _blocks(elements, blocks)
        with np.errstate(over="ignore"):
            h = _mix(_mix(x + U(level) * U(0xC2B2AE3D27D4EB4F), 0x9E3779B97F4A7C15, 29) + np.arange(blocks, dtype=U), 0xBF58476D1CE4E5B9, 32)
        first = np.lexsort((h, -np.minimum(n, ORDERED)))[: most + 1]
        return h[first], n[first]

    for level, most, blocks in bands.levels(len(s)):
        h, n = hashed(rare, level, most, blocks)
        out.append(h[n > 0])
        if not n.all():
            out.append(hashed(s, level + WHOLE, most, blocks)[0])
    return np.concatenate(out) if out else np.empty(0, dtype=U)


def sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Parities of the elements that fall on each of 64 x ``words`` bits."""
    at = ((s >> U(6)) % U(words)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, bit = at[order], (U(1) << (s & U(63)))[order]
    out = np.zeros(words, dtype=U)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] = np.bitwise_xor.reduceat(bit, first)
    return out


def sketch_words(n: int) -> int:
    """64-bit words for a set of n: four bits an element, a power of two, so that wide sketches fold to narrow ones."""
    return 1 << max(3, (n // 16).bit_length())


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.frombuffer(xxhash.xxh64_digest(s.tobytes()), dtype=">i8")[0])


def frequent_shingles(docs: DataFrame, width: int, one_in: int = 8, least: int = 6, most: int = 200_000) -> np.ndarray:
    """Sorted hashes of shingles that a sample finds in many documents. Any choice gives the same links; this one gives few candidates."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                found = [shingles(t, width) for t in batch.slice(i, 64).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])
        _WORDS.clear()

    count = written(some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "sketch-frequent")
    top = count.orderBy(F.desc("n"), "h").limit(most).collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(U))


def _sketch_rows(batches: Iterator[pa.RecordBatch], width: int, t: Fraction, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, node, sigs, sketch); a set met before in the partition hands in no signatures again."""
    bands, met = Bands(t), set()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            n, node, sigs, sketches = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                node.append(x := _node(s))
                new = len(s) and x not in met
                sigs.append(signatures(s, frequent, bands).view(np.int64) if new else None)
                sketches.append(sketch(s, sketch_words(len(s))).tobytes() if new else None)
                met.add(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sigs, pa.list_(pa.int64())),
                                              pa.array(sketches, pa.binary())], ["doc_id", "n", "node", "sigs", "sketch"])
    _WORDS.clear()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (sig, node) sorted by both: each node of a signature to its first node here.

    A signature may go on in the next partition: its rows there meet in a vertex named by the signature.
    """
    head_sig = head = last = None
    for batch in batches:
        sig, node = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(sig):
            continue
        new = np.empty(len(sig), dtype=bool)
        new[0] = head_sig is None or sig[0] != head_sig
        new[1:] = sig[1:] != sig[:-1]
        heads = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(heads >= 0, node[heads], head if head is not None else 0)
        linked = first != node
        a, b = [first[linked]], [node[linked]]
        if head_sig is None:
            a, b = [*a, node[:1]], [*b, sig[:1]]
        head_sig, head, last = sig[-1], first[-1], (node[-1:].copy(), sig[-1:].copy())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["a", "b"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sigs) rows to (part, nodes, sigs), a part being one of 2^RANGE_BITS ranges of signatures.

    A row holds what ``PACKED`` nodes have in a range, so its overhead is shared and there is about a row a node.
    """
    def packed(held):
        sigs = np.concatenate([s for _, s in held])
        node = np.concatenate([n for n, _ in held])
        part = (sigs.view(U) >> U(64 - RANGE_BITS)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ends = pa.array(np.append(first, len(part)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.ListArray.from_arrays(ends, pa.array(node[order])), pa.ListArray.from_arrays(ends, pa.array(sigs[order]))],
                                          ["part", "nodes", "sigs"])

    held, rows = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            b = batch.slice(i, 1024)
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            held.append((np.repeat(b.column(0).to_numpy(zero_copy_only=False), lengths), b.column(1).flatten().to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= PACKED:
                yield packed(held)
                held, rows = [], 0
    if held:
        yield packed(held)


def candidate_groups(rows: DataFrame) -> DataFrame:
    """(node, root): nodes that share blocks, directly or by others, have the same root."""
    dealt = rows.where("size(sigs) > 0").select("node", "sigs").mapInArrow(_dealt, "part int, nodes array<bigint>, sigs array<bigint>")
    sigs = dealt.repartition(shuffle_partitions(rows.sparkSession), "part").select(F.explode(F.arrays_zip("sigs", "nodes")).alias("x"))
    sigs = sigs.select(F.col("x.sigs").alias("sig"), F.col("x.nodes").alias("node"))
    sigs = sigs.sortWithinPartitions("sig", "node")  # spills; a signature of very many nodes is a stream of 16 bytes each
    return components(sigs.mapInArrow(_stars, "a bigint, b bigint"), "sketch-groups")


def by_id(docs: DataFrame, ids: DataFrame, id_col: str, slots: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Documents that certainly have none of the ids, and the rest. At most ``slots`` numbers are broadcast, so no text is shuffled."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    taken = F.broadcast(ids.select(slot(F.col("id")).alias("__slot")).distinct())
    here = slot(docs[id_col].cast(ids.schema["id"].dataType)) == taken["__slot"]
    return docs.join(taken, here, "left_anti"), docs.join(taken, here, "left_semi")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            sets = [shingles(t, width) for t in batch.slice(i, 256).column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["node", "elements"])
    _WORDS.clear()


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_tile(sets: list[np.ndarray], side: list[int], across: bool, t: Fraction, bits: int = 8) -> list[tuple[int, int]]:
    """Links (positions) that connect what the tile's linked pairs connect; ``across``: only pairs of different sides."""
    p, q = t.numerator, t.denominator
    size = np.array([len(s) for s in sets], dtype=np.int64)
    small = np.stack([sketch(s, bits) for s in sets])
    sides, forest, out = np.array(side), Forest(), []
    for i in range(len(sets) - 1):
        lo, hi = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        ok = hi * p <= lo * q
        if across:
            ok &= sides[i + 1 :] != sides[i]
        js = np.flatnonzero(ok)
        if not len(js):
            continue
        # the bound U - I <= (1 - t) U with U <= smaller / t
        apart = np.bitwise_count(small[i + 1 :][js] ^ small[i]).sum(axis=1, dtype=np.int64)
        for j in (js[apart * p <= lo[js] * (q - p)] + i + 1).tolist():
            if forest.root(i) == forest.root(j):
                continue
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if q * common >= p * (len(a) + len(b) - common):
                forest.join(i, j)
                out.append((i, j))
    return out


def sketch_tile(sizes: list[int], sketches: list[np.ndarray], side: list[int], across: bool, t: Fraction) -> list[tuple[int, int]]:
    """Pairs (positions) within the Hamming bound, as many as connect what all such pairs connect."""
    p, q = t.numerator, t.denominator
    n, sides, wide, forest, out = np.array(sizes), np.array(side), np.array([len(x) for x in sketches]), Forest(), []
    for w in sorted(set(wide.tolist())):
        own, next_ = np.flatnonzero(wide == w), np.flatnonzero(wide == 2 * w)  # linked sets differ by one step at most
        at = np.concatenate([own, next_])
        rows = np.stack([sketches[i] for i in own] + [sketches[i][:w] ^ sketches[i][w:] for i in next_])
        for x in range(len(own)):
            a, b = n[own[x]], n[at[x + 1 :]]
            ok = np.maximum(a, b) * p <= np.minimum(a, b) * q
            if across:
                ok &= sides[at[x + 1 :]] != sides[own[x]]
            js = np.flatnonzero(ok) + x + 1
            if not len(js):
                continue
            apart = np.bitwise_count(rows[js] ^ rows[x]).sum(axis=1, dtype=np.int64)
            for j in at[js[apart * (q + p) <= (a + n[at[js]]) * (q - p)]].tolist():  # d <= (a + b) (1 - t) / (1 + t)
                if forest.root(int(own[x])) != forest.root(j):
                    forest.join(int(own[x]), j)
                    out.append((int(own[x]), j))
    return out


def _by_sketch(rows: list[tuple], across: bool, t: Fraction) -> list[tuple[int, int]]:
    return sketch_tile([r[2] for r in rows], [np.frombuffer(r[3], dtype=U) for r in rows], [r[0] for r in rows], across, t)


def _by_set(rows: list[tuple], across: bool, t: Fraction) -> list[tuple[int, int]]:
    return link_tile([np.frombuffer(r[2], dtype=U) for r in rows], [r[0] for r in rows], across, t)


def _tiles(batches: Iterator[pa.RecordBatch], test, t: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows (root, x, y, side, node, ...) sorted by tile to edges; each tile is gathered by itself."""
    def links():
        return [(rows[i][1], rows[j][1]) for i, j in test(rows, key[1] != key[2], t)] if len(rows) > 1 else []

    def edges(out):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        out = []
        for root, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (root, x, y) != key:
                out += links()
                key, rows = (root, x, y), []
            rows.append(tuple(row))
        yield edges(out)
    yield edges(links())


def within(members: DataFrame, payload: list[str], test, t: Fraction) -> DataFrame:
    """(a, b) edges that ``test`` finds in the tiles of each group of (node, root, payload) rows.

    A group is dealt into chunks by hash, and each pair of chunks is a tile, so no task gathers a group.
    """
    count = members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    own = members.join(count, "root").withColumn("c", F.ceil(F.col("m") / F.lit(TILE // 2)).cast("int"))
    own = own.withColumn("side", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    tiles = tiles.select("root", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node", *payload)
    tiles = tiles.repartition(shuffle_partitions(members.sparkSession), "root", "x", "y").sortWithinPartitions("root", "x", "y")
    return tiles.mapInArrow(lambda b: _tiles(b, test, t), "a bigint, b bigint")


def sketch_groups(rows: DataFrame, groups: DataFrame, t: Fraction) -> DataFrame:
    """(node, root): components of the pairs in a candidate group that the Hamming bound lets pass."""
    own = rows.where("sketch IS NOT NULL").select("node", "n", "sketch").join(written(groups, "sketch-candidates"), "node").dropDuplicates(["node"])
    return components(within(written(own, "sketch-nodes"), ["n", "sketch"], _by_sketch, t), "sketch-tight")


def links(docs: DataFrame, rows: DataFrame, groups: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(a, b): verified links that connect the nodes of each group as all its links would."""
    groups = written(groups, "sketch-members")
    own = written(rows.join(groups, "node").groupBy("node", "root").agg(F.min("doc_id").alias("id")), "sketch-owners")
    wanted = own.select("id").distinct()
    some = by_id(docs, wanted, "doc_id")[1]
    texts = some.join(wanted, some["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(lambda b: _sets(b, width), "node bigint, elements binary")
    sets = written(sets.join(own.select("node", "root"), "node").dropDuplicates(["node"]), "sketch-sets")
    return within(sets, ["elements"], _by_set, t)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every document."""
    prepare(docs.sparkSession)
    t = Fraction(str(threshold))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = frequent_shingles(docs, width)
    rows = docs.mapInArrow(lambda b: _sketch_rows(b, width, t, frequent), f"doc_id {kind}, n bigint, node bigint, sigs array<bigint>, sketch binary")
    rows = written(rows, "sketch-rows")
    groups = sketch_groups(rows, candidate_groups(rows), t)
    rows = rows.select("doc_id", "n", "node")
    found = links(docs, rows.where("n > 0"), groups, width, t)
    linked = components(written(found, "sketch-links"), "sketch-components")
    rows = rows.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows, "sketch-rooted")
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    least = written(least, "sketch-least")  # one row a component; its documents may be a third of all, and AQE splits them
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Of each component the document with the smallest id, with its own columns.

    A document is known by its id and its text, so rows that share an id, or have none, are told apart: null ids come
    last, rows of one id go by their text's digest, and of rows that share both one stays. Without a shingle all stay.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.sha2(whole(F.col(text_col)), 256)).alias("digest"))
    docs = docs.withColumn("__key", key)
    near = near_components(docs, "__key", text_col, **kw).where("n_shingles > 0")
    near = near.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("doc_id") == F.col("component_id")
    some = written(near.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), stays.alias("stays")), "sketch-dropped")
    clear, rest = by_id(docs, some, "__key")
    clean = rest.join(some, rest["__key"] == some["id"], "left_anti")
    twice = some.where("stays")
    repeated = rest.join(twice, rest["__key"] == twice["id"], "left_semi").dropDuplicates(["__key"])
    return clear.unionByName(clean).unionByName(repeated).drop("__key")

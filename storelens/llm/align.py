"""Alignment of two tokenisations of the same text, with corpus-wide counts of linked token pairs.

Tokeniser A is a byte-level BPE, B a sentence-piece BPE; both cover the bytes of a space and the text. Byte
offsets where tokens of both end cut them into groups; all A-B pairs of a group are links. A pair's count is
the number of documents that hold it linked.

The text is cut at every space that follows a character that is no white space: no token of either vocabulary
reaches across, so a stretch's tokens, groups and links are computed once for all its occurrences (a bounded
table a worker). Documents are dealt to shards of about ``SHARD_ROWS`` rows. The first pass gives each shard's
distinct pairs with its number of documents, packed by bucket of the A id. Per bucket, a tree of small merges
unites the distinct keys, a minimal perfect hash numbers them, each shard's counts are added into dense
vectors at those numbers, and the vectors are summed up the tree. Each shard's keys are then looked up (the
key stored at the number is compared) and go back to the shard, where the second pass aligns its documents
again and adds up the counts. What a task holds is bounded by the vocabularies: a bucket's keys are at most
|A| / ``BUCKETS`` * |B|; nothing is broadcast but the two vocabulary files.

Defined results: texts that are null, empty or whose bytes a tokeniser doesn't give back have no tokens: zeros
and empty groups. Repeated rows each count as a document. An empty table gives an empty result. Other columns
pass through; those that bear a new column's name are replaced. Rows are dealt by the hash of id and text.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import prepare, written
from storelens.llm.mph import PerfectHash

SHARD_ROWS = 1000
BUCKETS = 256
FAN_IN = 32
WIDE = 4096  # shards whose rows of a bucket one task reads
MAX_STRETCHES = 1_000_000
MAX_STRETCH_CHARS = 40_000_000
MAX_LINKS = 8_000_000
BATCH_CHARS = 2_000_000
BATCH_BYTES = 4_000_000
SPACE = "▁"
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_AFTER_SPACE = re.compile(r"(?:^|\s) ")
_CUT = re.compile(r"(?<=\S) ")
NEW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (lengths[0] of them), first[1], ..."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


class Aligner:
    """Both tokenisers, and the stretches of text seen so far with their tokens, groups and links."""

    def __init__(self, a_vocabulary: bytes, b_model: bytes, say_groups: bool):
        import sentencepiece
        import tiktoken

        model, of = json.loads(a_vocabulary), byte_alphabet()
        special = {x["content"] for x in model["added_tokens"]}
        # a merge vocabulary's ids are in the order of its merges, so they serve as ranks
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.encode_a = tiktoken.Encoding("a", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.encode_b, self.b_space = b.encode, b.piece_to_id(SPACE)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in ((i, b.id_to_piece(i)) for i in range(len(b)))]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.say_groups = say_groups
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.said: list[str] = []
        self.table = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes are given back
        self.first = np.zeros(0, np.int64)  # link of a stretch
        self.links = np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Tokens, groups and links of stretches; each stands for a space and its characters."""
        data = [(" " + x).encode() for x in new]
        a = [self.encode_a(" " + x) for x in new]
        b = [y if x else [self.b_space] for x, y in zip(new, self.encode_b(new, num_threads=1))]
        given = [b"".join([self.a_bytes[i] for i in x]) == d and b"".join([self.b_bytes[i] for i in y]) == d for x, y, d in zip(a, b, data)]
        if not all(given):
            a, b = ([x if g else [] for x, g in zip(z, given)] for z in (a, b))
        a_n, b_n = (np.fromiter(map(len, z), np.int64, len(z)) for z in (a, b))
        a, b = _flat(a), _flat(b)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        mark = np.zeros((int(a_end[-1]) if len(a) else 0) + 1, np.int8)
        mark[a_end] += 1
        mark[b_end] += 1
        both = mark == 2
        done = np.cumsum(both)
        a_group, b_group, groups = done[a_end] - both[a_end], done[b_end] - both[b_end], int(done[-1])
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        b_first = np.cumsum(in_b) - in_b
        a_ptr = np.concatenate([[0], np.cumsum(a_n)])
        times = in_b[a_group]
        links = np.repeat(a, times) * len(self.b_bytes) + b[_ranges(b_first[a_group], times)]
        n_links = _sums(times, a_ptr)
        group_ptr = done[np.concatenate([[0], a_end])[a_ptr]]
        n_groups = np.diff(group_ptr)
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, links.astype(np.uint32)])
        self.table = np.concatenate([self.table, np.stack([a_n, b_n, n_groups, n_links, np.array(given, np.int64)])], 1)
        for x in new:
            self.number[x] = len(self.number)
        self.chars += sum(map(len, new))
        if self.say_groups:
            a_said, b_said, i, j, said = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, []
            for n, m in zip(in_a.tolist(), in_b.tolist()):
                said.append(f"{a_said[i]}|{b_said[j]}" if n == m == 1 else ",".join(a_said[i : i + n]) + "|" + ",".join(b_said[j : j + m]))
                i, j = i + n, j + m
            ptr = group_ptr.tolist()
            self.said += [";".join(said[lo:hi]) for lo, hi in zip(ptr, ptr[1:])]

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' stretches, and where each text's begin; texts without tokens have none."""
        if len(self.number) > MAX_STRETCHES or self.chars > MAX_STRETCH_CHARS or len(self.links) > MAX_LINKS:
            self._clear()
        cut = [[] if not x else _CUT.split(x) if _AFTER_SPACE.search(x) else x.split(" ") for x in texts]
        new = dict.fromkeys(x for xs in cut for x in xs if x not in self.number)
        if new:
            self._learn(list(new))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(n.sum()))
        ptr = np.concatenate([[0], np.cumsum(n)])
        given = _sums(1 - self.table[4][at], ptr) == 0
        if not given.all():
            at = at[np.repeat(given, n)]
            ptr = np.concatenate([[0], np.cumsum(n * given)])
        return at, ptr

    def linked(self, at: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of the stretches, and where each text's begin."""
        n = self.table[3][at]
        return self.links[_ranges(self.first[at], n)], np.concatenate([[0], np.cumsum(n)])[ptr]


_MADE: dict = {}  # of this worker process


def _aligner(files, say_groups: bool) -> Aligner:
    a, b = files.value
    key = (hash(a), hash(b), say_groups)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Aligner(a, b, say_groups)
    return _MADE[key]


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x or "") > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(x or "")
    if first < len(texts):
        yield first, len(texts)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _first_pass(files, b_size: int):
    """Rows of (shard, text) to rows of (bucket, shard, keys, counts), packed."""
    def run(batches):
        made, held, size, shard = _aligner(files, False), [], 0, None

        def out():
            keys, counts = _counted(held)
            bucket = keys // b_size % BUCKETS
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order].astype("<u4"), counts[order].astype("<i8"), bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*at[1:], len(keys)]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[at], pa.int32()), "shard": pa.array([shard] * len(at), pa.int32()),
                "keys": pa.array([keys[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
                "counts": pa.array([counts[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())})

        for batch in batches:
            shards, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _batches(texts):
                shard = shards[lo]
                links, ptr = made.linked(*made.stretches(texts[lo:hi]))
                doc = np.repeat(np.arange(hi - lo), np.diff(ptr))
                pairs = np.unique(doc << 32 | links) & 0xFFFFFFFF  # each document's distinct pairs
                held.append(np.unique(pairs, return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [_counted(held)]
                    size = 2 * len(held[0][0])  # grows with the distinct pairs, which the vocabularies bound
        if held:
            yield out()
    return run


def _merge_keys(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]))
    return table.slice(0, 1).set_column(2, "keys", pa.array([keys.tobytes()], pa.binary()))


def _add_vectors(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table["counts"].to_pylist())
    return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))


def _tree(rows: DataFrame, merge, parts: int) -> DataFrame:
    """Merge the rows (bucket, part, value) of each bucket, at most ``FAN_IN`` at a time, up to one a bucket."""
    while True:
        parts = -(-parts // FAN_IN)
        up = rows.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        rows = up.groupBy("bucket", "part").applyInArrow(merge, rows.schema)
        if parts == 1:
            return rows.drop("part")


def _numbered(batches):
    """Rows of (bucket, keys) to rows of (bucket, hash, keys): the keys stand in the order of their numbers."""
    for batch in batches:
        hashes, ordered = [], []
        for x in batch.column(1).to_pylist():
            keys = np.frombuffer(x, "<u4")
            made = PerfectHash.build(keys)
            to = np.empty_like(keys)
            to[made.index(keys)] = keys
            hashes.append(made.to_bytes())
            ordered.append(to.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(ordered, pa.binary())], ["bucket", "hash", "keys"])


def _with_best(b_size: int):
    """Add whether a pair's count is the highest of its A id; a bucket holds all pairs of an A id."""
    def run(batches):
        for batch in batches:
            best = []
            for keys, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, n = np.frombuffer(keys, "<u4") // b_size, np.frombuffer(counts, "<i8")
                top = np.zeros(int(a.max()) // BUCKETS + 1, np.int64)
                np.maximum.at(top, a // BUCKETS, n)
                best.append((n == top[a // BUCKETS]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], [*batch.schema.names, "best"])
    return run


def _with_bucket(shards: DataFrame, buckets: DataFrame, n_shards: int) -> DataFrame:
    """Each bucket's row (part -1), followed by the shards' rows of it; at most ``WIDE`` shards a task."""
    wide = F.explode(F.sequence(F.lit(0), F.lit((n_shards - 1) // WIDE)))
    heads = buckets.withColumn("shard", F.lit(-1)).withColumn("wide", wide)
    tails = shards.withColumn("wide", F.expr(f"shard div {WIDE}").cast("int"))
    both = heads.unionByName(tails.withColumnRenamed("keys", "own").withColumnRenamed("counts", "n"), allowMissingColumns=True)
    return both.repartition("bucket", "wide").sortWithinPartitions("bucket", "wide", "shard")


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _at(head: tuple, keys: np.ndarray) -> np.ndarray:
    at = head[0].index(keys)
    if (at < 0).any() or (head[1][at] != keys).any():
        raise ValueError("a key is not in its bucket's table")
    return at


def _packed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _dense(batches) -> Iterator[dict]:
    """Add the shards' counts into dense vectors at the keys' numbers, one vector for ``FAN_IN`` shards."""
    head = out = None
    for r in _rows(batches):
        at = {"bucket": r["bucket"], "part": r["shard"] // FAN_IN}
        if out and at != {k: out[k] for k in at}:
            yield out | {"counts": out["counts"].tobytes()}
            out = None
        if r["shard"] < 0:
            head = (PerfectHash.from_bytes(r["hash"]), np.frombuffer(r["keys"], "<u4"))
            continue
        out = out or at | {"counts": np.zeros(len(head[1]), "<i8")}
        out["counts"][_at(head, np.frombuffer(r["own"], "<u4"))] += np.frombuffer(r["n"], "<i8")
    if out:
        yield out | {"counts": out["counts"].tobytes()}


def _looked_up(batches) -> Iterator[dict]:
    """The shards' own keys with their counts, and whether these are the best."""
    head = None
    for r in _rows(batches):
        if r["shard"] < 0:
            head = (PerfectHash.from_bytes(r["hash"]), np.frombuffer(r["keys"], "<u4"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["best"], bool))
            continue
        at = _at(head, np.frombuffer(r["own"], "<u4"))
        yield {"shard": r["shard"], "keys": r["own"], "counts": head[2][at].tobytes(), "best": head[3][at].tobytes()}


_VECTOR = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
_LOOKED_UP = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def _second_pass(files, keep_text: bool):
    """A shard's looked-up keys, then its documents: each row with its numbers and groups."""
    def run(batches):
        made, held, table = _aligner(files, True), [], None
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            kinds = col["kind"].to_pylist()
            n = kinds.count(0)  # the keys' rows come first
            held += [[np.frombuffer(col[c][i].as_py(), t) for c, t in (("keys", "<u4"), ("counts", "<i8"), ("best", bool))] for i in range(n)]
            if n == len(kinds):
                continue
            if table is None:
                keys, counts, best = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, t) for t in ("<u4", "<i8", bool))
                order = np.argsort(keys)
                table, held = (keys[order], counts[order], best[order]), []
            texts = col["text"].slice(n).to_pylist()
            for lo, hi in _batches(texts):
                at, ptr = made.stretches(texts[lo:hi])
                links, link_ptr = made.linked(at, ptr)
                where = np.searchsorted(table[0], links)
                out = [_sums(made.table[k][at], ptr) for k in range(4)] + [_sums(table[2][where], link_ptr), _sums(table[1][where], link_ptr)]
                said, p = list(map(made.said.__getitem__, at.tolist())), ptr.tolist()
                groups = [";".join(said[i:j]) for i, j in zip(p, p[1:])]
                rest = [col[c].slice(n + lo, hi - lo) for c in ("row", "text")[: 1 + keep_text]]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, pa.int64()) for x in out), pa.array(groups, pa.string())],
                                                 [*("row", "text")[: 1 + keep_text], *NEW])
    return run


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add to every document n_a, n_b, n_groups, n_links, n_best, count_sum and the groups (``a1,a2|b1;a3|b2``).

    ``n_best`` counts the links whose count is the highest of their A id, ``count_sum`` adds up all links' counts.
    Without ``keep_text`` the text is not returned.
    """
    import sentencepiece

    spark = docs.sparkSession
    prepare(spark)
    files = []
    for p in (a_path, b_path):
        with open(p, "rb") as f:
            files.append(f.read())
    b_size = len(sentencepiece.SentencePieceProcessor(model_proto=files[1]))
    files = spark.sparkContext.broadcast(files)  # two vocabulary files, of fixed size
    n = max(1, -(-docs.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(*[c for c in ("doc_id", text_col) if c in docs.columns]), F.lit(n)).cast("int")
    dealt = docs.select(shard.alias("shard"), F.col(text_col).alias("text"))
    packed = "bucket int, shard int, keys binary, counts binary"
    first = written(dealt.repartitionById(n, "shard").mapInArrow(_first_pass(files, b_size), packed), "align-shards")

    united = _tree(first.select("bucket", F.col("shard").alias("part"), "keys"), _merge_keys, n)
    numbered = written(united.mapInArrow(_numbered, "bucket int, hash binary, keys binary"), "align-keys")
    vectors = _with_bucket(first, numbered, n).mapInArrow(lambda x: _packed(_dense(x), _VECTOR), "bucket int, part int, counts binary")
    summed = numbered.join(_tree(vectors, _add_vectors, -(-n // FAN_IN)), "bucket").select("bucket", "hash", "keys", "counts")
    counted = written(summed.mapInArrow(_with_best(b_size), "bucket int, hash binary, keys binary, counts binary, best binary"), "align-counts")
    looked_up = _with_bucket(first, counted, n).mapInArrow(lambda x: _packed(_looked_up(x), _LOOKED_UP), "shard int, keys binary, counts binary, best binary")

    rest = [c for c in docs.columns if c not in NEW and c != text_col]
    row = F.struct(F.lit(0).alias("-"), *rest)
    rows = docs.select(shard.alias("shard"), F.lit(1).alias("kind"), F.col(text_col).alias("text"), row.alias("row"))
    both = looked_up.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    both = both.repartitionById(n, "shard").sortWithinPartitions("kind")
    fields = [f for f in rows.schema.fields if f.name in ("row", "text")[: 1 + keep_text]][::-1]
    fields += [T.StructField(c, T.StringType() if c == "groups" else T.LongType()) for c in NEW]
    done = both.mapInArrow(_second_pass(files, keep_text), T.StructType(fields))
    at = {c: F.col("row")[c] for c in rest} | ({text_col: F.col("text")} if keep_text else {})
    return done.select(*[at[c].alias(c) for c in docs.columns if c in at], *NEW)


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its numbers and groups_sha256 (empty without tokens)."""
    done = align(docs.select("doc_id", "text"), a_path, b_path, keep_text=False)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return done.select("doc_id", *NEW[:-1], digest.alias("groups_sha256"))

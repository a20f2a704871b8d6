"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A merge vocabulary fixes, for every prefix of a piece, the one token that its encoding ends with: the
suffix that is a token, is reproduced by its own merges and fits the token before it. The transducer
reads bytes; its states are the sets of open positions, those from which a longer token may still start,
each with the token before it. An arc gives the token that the prefix up to its byte ends with. Tokens
that the paths to all open positions share are final and are emitted at least every ``WINDOW`` bytes, so
the lookahead is bounded. States and arcs are built when a text first needs them, at most ``MAX_STATES``
at once; then the tables start afresh from the state at hand. Time is linear in a piece's length.

Decoding runs the UTF-8 state machine, lifted to tokens: an arc of (bytes held back, token) gives the
characters that are complete now and the bytes still held back.

Defined results: null text is the empty text and has no tokens; texts that hold special tokens' strings
are ordinary text; decoding bytes that are no UTF-8 puts U+FFFD in place of each faulty byte; null ids
decode to the empty text; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import math
import threading
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import prepare, whole

MAX_STATES = 200_000
WINDOW = 512
FEW = 12
_BYTES = [bytes((i,)) for i in range(256)]
MAX_PIECES = 250_000
MAX_PAIRS = 400_000
MAX_ALIVE = 150_000
ID_BITS = 24  # an arc packs the next state and a token into one integer
_ID = (1 << ID_BITS) - 1
CACHED_PIECE_CHARS = 48
BATCH_ROWS = 256


def load_ranks(path: str) -> bytes:
    """The rank file as it is; it is small and of fixed size, and travels to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in ranks.splitlines() if x)}


class Transducer:
    """Encodes pieces (bytes) to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of = {r: t for t, r in ranks.items()}
        # tokens that merging their own bytes doesn't lead back to can only stand for a whole piece
        self.tokens: dict[bytes, int] = {}
        # how a token's last (first) part grows while its bytes merge: (part, rank of the merge that takes it in)
        self.last: dict[int, list[tuple[bytes, float]]] = {}
        self.first: dict[int, list[tuple[bytes, float]]] = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1] if len(x[0]) > 1 else -1):
            halves = self.parts(t, 2)
            if len(t) > 1 and (len(halves) != 2 or max(self._time(h) for h in halves) >= r or ranks[halves[0]] not in self.last
                               or ranks[halves[1]] not in self.last):
                continue
            self.tokens[t] = r
            own = [(t, math.inf)]
            self.last[r] = own if len(t) == 1 else [(p, min(c, r)) for p, c in self.last[ranks[halves[1]]]] + own
            self.first[r] = own if len(t) == 1 else [(p, min(c, r)) for p, c in self.first[ranks[halves[0]]]] + own
        self.longer: dict[bytes, list[int]] = {}  # the tokens that go on from their proper prefix
        for t, r in self.tokens.items():
            for i in range(1, len(t)):
                self.longer.setdefault(t[:i], []).append(r)
        self.pairs: dict[int, bool] = {}
        self.alive: dict[tuple[int, bytes], bool] = {}
        self._clear()

    def _time(self, part: bytes) -> int:
        return self.ranks[part] if len(part) > 1 else -1

    def parts(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition of the encoding: join the adjacent pair of lowest rank until none is a token, or ``least`` are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
            if r == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge reaches across their border.

        Merges happen in the order of their ranks. One reaches across if the parts at the border can
        merge before the merge inside a, or inside b, that takes them in; of equal ranks the left goes first.
        """
        got = self.pairs.get(a << ID_BITS | b)
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            rank = self.ranks.get
            got = self.pairs[a << ID_BITS | b] = not any((r := rank(x + y)) is not None and r < until_x and r <= until_y
                                             for x, until_x in self.last[a] for y, until_y in self.first[b])
        return got

    def goes_on(self, before: int, since: bytes) -> bool:
        """Whether a longer token that begins with ``since`` may follow ``before``; where many begin so, taken for granted."""
        longer = self.longer.get(since)
        if longer is None or before < 0 or len(longer) > FEW:
            return longer is not None
        got = self.alive.get((before, since))
        if got is None:
            if len(self.alive) >= MAX_ALIVE:
                self.alive.clear()
            got = self.alive[before, since] = any([self.fits(before, t) for t in longer])
        return got

    def _clear(self) -> None:
        # a state: for each open position, the token that ends there (-1 at the start) and the bytes since; the last is the end
        self.keys: list[tuple[tuple[int, bytes], ...]] = []
        self.number: dict[tuple, int] = {}
        self.arcs: dict[int, int] = {}  # state and byte: next state and token
        self._state(((-1, b""),))

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
        return n

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the token that the prefix up to this byte ends with."""
        b, after, end = _BYTES[byte], [], -1
        for before, since in self.keys[state]:
            s = since + b
            if end < 0:
                t = self.tokens.get(s, -1)
                if t >= 0 and (before < 0 or self.fits(before, t)):
                    end = t
            if self.goes_on(before, s):
                after.append((before, s))
        if end < 0:
            raise ValueError("the vocabulary's merges are not consistent")
        after.append((end, b""))
        key = tuple(after)
        if len(self.keys) >= MAX_STATES and key not in self.number:  # start afresh, from this state
            self._clear()
            return self._state(key), end
        to = self._state(key)
        self.arcs[state << 8 | byte] = to << ID_BITS | end
        return to, end

    def _path(self, ends: list[int], to: int) -> list[int]:
        """Token ids that lead to the position ``to``."""
        out = []
        while to > 0:
            out.append(ends[to - 1])
            to -= len(self.of[ends[to - 1]])
        return out[::-1]

    def _final(self, state: int, ends: list[int]) -> list[int]:
        """Emit the tokens that the paths to all open positions share, and forget their bytes."""
        paths = [self._path(ends, len(ends) - len(since)) for _, since in self.keys[state]]
        n = min(map(len, paths))
        k = next((i for i in range(n) if len({p[i] for p in paths}) > 1), n)
        del ends[: sum(len(self.of[t]) for t in paths[0][:k])]
        return paths[0][:k]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        state, out, ends, window = 0, [], [], WINDOW
        for byte in piece:
            arc = self.arcs.get(state << 8 | byte)
            state, t = self._arc(state, byte) if arc is None else (arc >> ID_BITS, arc & _ID)
            ends.append(t)
            if len(ends) >= window:
                out += self._final(state, ends)
                window = max(WINDOW, 2 * len(ends))
        return out + self._path(ends, len(ends))


class Encoder(dict):
    """Text to packed ids; maps pieces seen to their packed ids."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        super().__init__()
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(parse_ranks(ranks))

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


class Decoder:
    """Ids to text as they come in; bytes of an unfinished character are held back."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.rows: dict[bytes, dict[int, tuple[str, dict]]] = {}
        self.held: dict[int, bytes] = {}
        self.row = self.ready = self._row(b"")

    def _row(self, held: bytes) -> dict:
        row = self.rows.get(held)
        if row is None:
            row = self.rows[held] = {}
            self.held[id(row)] = held
        return row

    def _arc(self, row: dict, token: int) -> tuple[str, dict]:
        text, held = utf8(self.held[id(row)] + self.tokens[token])
        got = row[token] = (text, self._row(held))
        return got

    def feed(self, ids: Iterable[int]) -> str:
        row, out = self.row, []
        for t in ids:
            text, row = row.get(t) or self._arc(row, t)
            out.append(text)
        self.row = row
        return "".join(out)

    def finish(self) -> str:
        rest, self.row = self.held[id(self.row)], self.ready
        return "�" * len(rest)


def utf8(data: bytes) -> tuple[str, bytes]:
    """The UTF-8 state machine: characters complete in ``data``, and the bytes of one that may still be completed.

    States: bytes still due, and the range of the next one (RFC 3629, table of well-formed sequences).
    """
    out, start, due, low, high = [], 0, 0, 0x80, 0xBF
    i = 0
    while i < len(data):
        b = data[i]
        if due == 0:
            start = i
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
            i += 1
        elif low <= b <= high:
            due, low, high = due - 1, 0x80, 0xBF
            i += 1
            if due == 0:
                out.append(_char(data[start:i]))
        else:  # the sequence breaks off; the byte starts anew
            out.append("�" * (i - start))
            due = 0
    return "".join(out), data[start:] if due else b""


def _char(seq: bytes) -> str:
    value = seq[0] & (0xFF >> (len(seq) + 1))
    for b in seq[1:]:
        value = value << 6 | b & 0x3F
    return chr(value)


IDLE_SECONDS = 5.0
_MADE: dict = {}  # of this worker process; up to about 200 MB
_TIMER: list[threading.Timer] = []


def _give_back() -> None:
    _MADE.clear()
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def _in_use():
    """What a task has made serves the worker's next tasks; once none has come for ``IDLE_SECONDS`` it goes.

    Spark keeps idle workers for a minute: their tables would lie beside the memory of other stages.
    """
    while _TIMER:
        _TIMER.pop().cancel()
    try:
        yield
    finally:
        timer = threading.Timer(IDLE_SECONDS, _give_back)
        timer.daemon = True
        _TIMER.append(timer)
        timer.start()


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _MADE:
        _MADE[key] = Encoder(ranks, pattern)
    return _MADE[key]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def _encoding(ranks, pattern: str, at: int, to: str):
    """Batches with the packed ids of column ``at`` added; ``ranks`` is a broadcast."""
    def run(batches):
        with _in_use():
            made = _encoder(ranks.value, pattern)
            for b in _rows(batches):
                ids = pa.array([made.encode(t or "") for t in b.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, to])
    return run


def _decoding(ranks, at: int, to: str):
    """Batches with the decoded text of the packed ids in column ``at`` added."""
    def run(batches):
        with _in_use():
            key = ("decoder", hashlib.sha256(ranks.value).digest())
            if key not in _MADE:
                _MADE[key] = Decoder({r: t for t, r in parse_ranks(ranks.value).items()})
            made = _MADE[key]
            for b in _rows(batches):
                out = [made.feed(np.frombuffer(x or b"", dtype="<u4").tolist()) + made.finish() for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, to])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Add ``to``: the ids of the whole text, packed as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.BinaryType())])
    return docs.mapInArrow(_encoding(ranks, pattern, docs.columns.index(text_col), to), schema)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: the text of the packed ids, decoded as a stream."""
    prepare(rows.sparkSession)
    ranks = rows.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])
    return rows.mapInArrow(_decoding(ranks, rows.columns.index(ids_col), to), schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with the text replaced by ``ids`` and ``decoded``; both passes in one worker, as for a check."""
    prepare(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    at, rest = docs.columns.index(text_col), [f for f in docs.schema.fields if f.name != text_col]
    first, second = _encoding(ranks, pattern, at, "ids"), _decoding(ranks, len(rest), "decoded")

    def run(batches):
        coded = (pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at], [n for i, n in enumerate(b.schema.names) if i != at])
                 for b in first(batches))
        yield from second(coded)

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    back = round_trip(docs.select("doc_id", whole(F.col("text")).alias("text")), ranks_path, pattern)
    return back.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

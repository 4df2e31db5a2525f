"""Byte-level BPE: a pre-tokeniser as an associative scan over codepoint classes, cached merges, decoding by offsets."""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, LETTER, NUMBER, OTHER, SPACE, bounded_batches, codepoint_classes, codepoints, text_slices

RANKS = "byte_bpe_50k.tiktoken"

# Input classes. An apostrophe that a contraction follows has a class of its own; so has the last white space before
# something else, as it joins what follows (a blank) or stands alone (any other). END stands between texts.
_OTHER, _LETTER, _NUMBER, _TAIL1, _TAIL2, _BLANK_LAST, _SPACE_LAST, _SPACE, _END, _SAME = range(10)
# States: at a piece's start; within letters, numbers, others; after a joining blank; within white space; one or two
# letters of a contraction to come.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_TAIL1, S_TAIL2 = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here" for each (class, state)."""
    go, cut = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for cls, into, runs in ((_LETTER, S_LETTER, [S_LETTER]), (_NUMBER, S_NUMBER, [S_NUMBER]), (_OTHER, S_OTHER, [S_OTHER]), (_SPACE, S_SPACE, [S_SPACE])):
        go[cls] = into
        cut[cls, runs if cls == _SPACE else [*runs, S_BLANK]] = False
    for cls, tail in ((_TAIL1, S_TAIL1), (_TAIL2, S_TAIL2)):
        go[cls] = tail
        go[cls, [S_OTHER, S_BLANK]] = S_OTHER
        cut[cls, [S_OTHER, S_BLANK]] = False
    go[_LETTER, S_TAIL2], go[_LETTER, S_TAIL1] = S_TAIL1, S_START
    cut[_LETTER, [S_TAIL1, S_TAIL2]] = False
    go[_BLANK_LAST], go[_SPACE_LAST], go[_END] = S_BLANK, S_START, S_START
    go[_SAME], cut[_SAME] = np.arange(8), False
    return go, cut


_GO, _CUT = _machine()


def boundaries(cp: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where pieces start in a run of texts; ``end`` marks the separators (codepoint 0), which are pieces themselves.

    Each codepoint is a function from states to states. Functions compose associatively: all rows of a block grid
    compose theirs at once, a doubling scan composes the rows', and each row then replays from its known state.
    """
    n = len(cp)
    kind = codepoint_classes()[cp]
    cls = np.array([_OTHER, _LETTER, _NUMBER, _SPACE], np.uint8)[kind]
    nxt = np.append(cp[1:], [0, 0])
    quote = np.flatnonzero(cp == ord("'"))
    one, two = nxt[quote], nxt[quote + 1]
    pair = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    cls[quote[np.isin(one, [ord(c) for c in "stmd"])]] = _TAIL1
    cls[quote[pair]] = _TAIL2
    space = kind == SPACE
    last = space & np.append(~space[1:] & ~end[1:], False)
    cls[last] = np.where(cp[last] == ord(" "), _BLANK_LAST, _SPACE_LAST)
    cls[end] = _END

    rows = max(1, int((n * 8) ** 0.5))
    steps = -(-n // rows)
    grid = np.full(rows * steps, _SAME, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, steps).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat, cut = _GO.ravel(), _CUT.ravel()
    for k in range(steps):
        whole = flat[(grid[k].astype(np.intp) * 8)[:, None] + whole]
    shift = 1
    while shift < rows:
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift].copy(), axis=1)
        shift *= 2
    state = np.concatenate(([S_START], whole[:-1, S_START])).astype(np.intp)
    out = np.empty((steps, rows), bool)
    for k in range(steps):
        at = grid[k].astype(np.intp) * 8 + state
        out[k] = cut[at]
        state = flat[at].astype(np.intp)
    return out.T.ravel()[:n]


#: Bytes up to which a piece is merged by scanning its list of pairs.
SHORT, NONE = 48, 1 << 40


def _pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each two tokens that make a third, by left rank << 32 | right rank."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a << 32 | b] = rank
    return out


def _merge_short(part: list[int], get) -> list[int]:
    """The same merges over ranks, as a merged pair's rank is its token."""
    pair = [get(a << 32 | b, NONE) for a, b in itertools.pairwise(part)]
    while pair and (least := min(pair)) < NONE:
        i = pair.index(least)
        part[i] = least
        del part[i + 1], pair[i]
        if i:
            pair[i - 1] = get(part[i - 1] << 32 | least, NONE)
        if i < len(pair):
            pair[i] = get(least << 32 | part[i + 1], NONE)
    return part


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the lowest-ranked adjacent pair, leftmost first, until none is left; a heap keeps long pieces n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    part = [piece[i : i + 1] for i in range(n)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not part[i] or (j := right[i]) >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = b""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
        if (h := left[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [ranks[p] for p in part if p]


class Codec:
    """Ranks, the merges seen of late (two generations of bounded size), and the tokens' bytes in one array."""

    CACHE, LONGEST = 60_000, 64

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        by_id = {r: t for t, r in self.ranks.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = [self.ranks[bytes([c])] for c in range(256)]
        self.pairs = _pairs(self.ranks)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, piece: bytes) -> bytes:
        found = self.cache.get(piece) or self.older.get(piece)
        if found is None:
            if (whole := self.ranks.get(piece)) is not None:
                ids = [whole]
            elif len(piece) <= SHORT:
                ids = _merge_short([self.single[c] for c in piece], self.pairs.get)
            else:
                ids = merge(piece, self.ranks)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= self.LONGEST:
            if len(self.cache) >= self.CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = found
        return found

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, unsigned 32-bit, and the byte at which each token starts: its piece's, and what of the piece comes before it."""
        joined = b"\0".join(texts) + b"\0"
        cp = codepoints(joined.decode("utf-8", "surrogatepass"))
        at = np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))
        end = np.zeros(len(cp), bool)
        stops = np.cumsum([len(t) + 1 for t in texts])
        end[np.searchsorted(at, stops)] = True
        first = np.flatnonzero(boundaries(cp, end))
        starts = np.concatenate(([0], at))[first]
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)], strict=True)]
        coded: list[bytes] = []
        for i in range(0, len(pieces), self.CACHE):
            get, ids = self.cache.get, self.ids  # a generation may end, but what this one has stays right
            coded += [get(p) or ids(p) for p in pieces[i : i + self.CACHE]]
        ids = np.frombuffer(b"".join(coded), "<u4")
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)))
        size = self.size[ids]
        before = np.cumsum(size) - size
        offsets = before + np.repeat(starts - before[upto[:-1]], np.diff(upto))
        # Between two texts stands a piece of its own.
        cuts = np.searchsorted(starts, stops - 1)
        first, last = upto[np.append(0, cuts[:-1] + 1)].tolist(), upto[cuts].tolist()
        begin = np.append(0, stops[:-1]).tolist()
        return [(ids[a:b], (offsets[a:b] - o).astype("<u4")) for a, b, o in zip(first, last, begin, strict=True)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Lays the bytes of each token at its offset, counted from the first token's; so any run of a text's tokens can be decoded."""
        if not len(ids):
            return b""
        size = self.size[ids]
        at = offsets.astype(np.int64) - int(offsets[0])
        return self.bytes[np.arange(int(at[-1] + size[-1])) + np.repeat(self.start[ids] - at, size)].tobytes()


@functools.lru_cache(maxsize=1)
def _codec(data: bytes) -> Codec:
    return Codec(data)


def _ranks(df: DataFrame, path: str | None):
    """The rank file (a fixed file of under 1 MB) as a broadcast."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, replace: bool = False) -> DataFrame:
    """All columns of ``df``, then n_tokens long, ids binary (unsigned 32-bit little-endian), offsets binary (the same, each token's first byte).

    Null texts are empty: no token. Repeated rows are coded again; an empty table gives none. Clashing columns named
    n_tokens, ids or offsets are replaced. ``replace`` drops the text column. Texts are coded in slices of CHUNK_BYTES, and
    a single longer text on its own; the cache of merges is bounded.
    """
    bounded_batches(df.sparkSession)
    ranks = _ranks(df, ranks_path)
    df = df.drop("n_tokens", "ids", "offsets")
    at = df.columns.index(text_col)
    keep = [f for f in df.schema.fields if not (replace and f.name == text_col)]
    places = [df.columns.index(f.name) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            coded = [x for _, texts in text_slices(batch.column(at)) for x in codec.encode(texts)]
            arrays = [pa.array([len(x) for x, _ in coded], pa.int64()), pa.array([x.tobytes() for x, _ in coded], pa.binary()), pa.array([o.tobytes() for _, o in coded], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *arrays], names=[*(f.name for f in keep), "n_tokens", "ids", "offsets"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
    return df.mapInArrow(run, ", ".join([*kinds, "n_tokens long", "ids binary", "offsets binary"]))


def decode(df: DataFrame, ranks_path: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns of an encoded table but offsets, and ``out`` binary: the bytes of the ids. Null ids give no bytes."""
    bounded_batches(df.sparkSession)
    ranks = _ranks(df, ranks_path)
    df = df.drop(out)
    ids_at, offsets_at = df.columns.index("ids"), df.columns.index("offsets")
    keep = [f for f in df.schema.fields if f.name != "offsets"]
    places = [df.columns.index(f.name) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            pairs = zip(batch.column(ids_at).fill_null(b"").to_pylist(), batch.column(offsets_at).fill_null(b"").to_pylist(), strict=True)
            texts = [codec.decode(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(texts, pa.binary())], names=[*(f.name for f in keep), out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
    return df.mapInArrow(run, ", ".join([*kinds, f"`{out}` binary"]))


def round_trip(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns of ``df`` but the text, then n_tokens, ids and ``out``: ``encode`` and ``decode`` in one pass.

    The same rows as one after the other, with one Python worker a task instead of two and without sending offsets.
    """
    bounded_batches(df.sparkSession)
    ranks = _ranks(df, ranks_path)
    df = df.drop("n_tokens", "ids", out)
    at = df.columns.index(text_col)
    keep = [f for f in df.schema.fields if f.name != text_col]
    places = [df.columns.index(f.name) for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            coded = [x for _, texts in text_slices(batch.column(at)) for x in codec.encode(texts)]
            arrays = [pa.array([len(x) for x, _ in coded], pa.int64()), pa.array([x.tobytes() for x, _ in coded], pa.binary()), pa.array([codec.decode(x, o) for x, o in coded], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *arrays], names=[*(f.name for f in keep), "n_tokens", "ids", out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
    return df.mapInArrow(run, ", ".join([*kinds, "n_tokens long", "ids binary", f"`{out}` binary"]))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of an encoded and decoded table."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

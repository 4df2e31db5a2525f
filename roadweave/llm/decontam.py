"""Benchmark decontamination: one Aho-Corasick automaton over the words of all items, one scan of each text."""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import BATCH_BYTES, bounded_batches, text_slices

#: Words a window.
WINDOW = 10
#: Words that one lane of a scan reads; all lanes of a slice read side by side.
LANE = 48
#: Word bytes are a-z, 0-9 and all beyond ASCII, after A-Z are lower-cased; any other byte becomes a blank, so offsets stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What stands between texts; no word, as its byte becomes a blank.
BETWEEN = b"\0"


def normalise(text: bytes) -> bytes:
    return text.translate(NORMAL)


@dataclass
class Automaton:
    """Aho-Corasick over word numbers, in arrays.

    A node is a run of up to ``window`` words that stands in an item; node 0 is the root, and nodes are numbered by their
    length, then parent, then word, so ``edge`` (parent and word in one number) is sorted and an edge's place is its
    child's number less one. Without its first word a run is a run too: that is its ``fail`` node. ``first[d]`` is the
    first node of d words. ``ends`` are the nodes at which a window ends, sorted, and ``owner[at[i]:at[i + 1]]`` its items.
    ``short`` marks the nodes that end with an item shorter than a window.
    """

    window: int
    words: bytes
    edge: np.ndarray
    fail: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    short: np.ndarray

    @classmethod
    def of(cls, items: list[bytes], window: int) -> Automaton:
        number: dict[bytes, int] = {}
        runs = [normalise(t).split() for t in items]
        ids = np.full(sum(map(len, runs)) + len(runs), -1, np.int32)
        start = np.cumsum([0, *(len(r) + 1 for r in runs[:-1])]) if runs else np.empty(0, np.int64)
        size = np.array([len(r) for r in runs], np.int64)
        for s, r in zip(start.tolist(), runs, strict=True):
            ids[s : s + len(r)] = [number.setdefault(w, len(number)) for w in r]
        del runs
        item = np.repeat(np.arange(len(items), dtype=np.int32), size + 1)
        node = ids + 1
        base = len(number) + 1
        edges, fails, first = [np.arange(base - 1, dtype=np.int64)], [np.zeros(base - 1, np.int32)], [0, 1, base]
        ends: list[np.ndarray] = []
        for d in range(1, window + 1):
            if d > 1:
                go = np.flatnonzero((node[: -(d - 1)] > 0) & (ids[d - 1 :] >= 0)) if len(ids) >= d else np.empty(0, np.int64)
                edge, which = np.unique(node[go].astype(np.int64) << 32 | ids[go + d - 1], return_inverse=True)
                fail = np.empty(len(edge), np.int32)
                fail[which] = node[go + 1]
                node = np.zeros_like(node)
                node[go] = base + which
                base += len(edge)
                edges.append(edge)
                fails.append(fail)
                first.append(base)
            # Windows end at runs of full length, and at the runs that are whole shorter items.
            mine = np.flatnonzero(node > 0) if d == window else start[size == d]
            ends.append(np.unique(node[mine].astype(np.int64) << 32 | item[mine]))
        if base > 2**31 - 1:
            raise ValueError("the items have more runs of words than a node number can tell apart")
        owned = np.concatenate(ends)
        fail = np.concatenate([np.zeros(1, np.int32), *fails])
        nodes, at = np.unique(owned >> 32, return_index=True)
        short = np.zeros(base if len(nodes) and nodes[0] < first[window] else 0, bool)
        if len(short):
            short[nodes[nodes < first[window]]] = True
            for d in range(2, window + 1):
                short[first[d] : first[d + 1]] |= short[fail[first[d] : first[d + 1]]]
        return cls(window, b" ".join(number), np.concatenate(edges), fail, np.array(first), nodes, np.append(at, len(owned)), (owned & 0xFFFFFFFF).astype(np.int32), short)

    def pack(self) -> bytes:
        """All of it in one run of bytes, from which ``unpack`` needs no copy."""
        parts = [np.frombuffer(self.words, np.uint8), self.edge, self.fail, self.first, self.ends, self.at, self.owner, self.short.view(np.uint8)]
        sizes = np.array([self.window, *(p.nbytes for p in parts)], np.int64)
        return MAGIC + b"".join([sizes.tobytes(), *(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)])

    @classmethod
    def unpack(cls, data: np.ndarray) -> Automaton:
        sizes = np.frombuffer(data[len(MAGIC) : len(MAGIC) + 72], np.int64).tolist()
        place, parts = len(MAGIC) + 72, []
        for n, kind in zip(sizes[1:], (np.uint8, np.int64, np.int32, np.int64, np.int64, np.int64, np.int32, bool), strict=True):
            parts.append(np.frombuffer(data[place : place + n], kind))
            place += n + -n % 8
        return cls(sizes[0], parts[0].tobytes(), *parts[1:])

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split())}

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Each state's next one after its word: along an edge, else along that of the nearest fail node that has one."""
        out = np.where(word >= 0, word + 1, 0)  # the root's edges are the words themselves
        lane = np.flatnonzero((state > 0) & (word >= 0))
        at, w = state[lane], word[lane]
        while len(lane):
            want = at.astype(np.int64) << 32 | w
            place = np.searchsorted(self.edge, want)
            found = self.edge[np.minimum(place, len(self.edge) - 1)] == want
            out[lane[found]] = place[found] + 1
            at = self.fail[at]
            rest = ~found & (at > 0)
            lane, at, w = lane[rest], at[rest], w[rest]
        return out

    def states(self, word: np.ndarray) -> np.ndarray:
        """The state after each word (number, or below 0 for none of the items').

        A state depends on the last ``window`` words only, so the words are cut into lanes, each of which starts from the
        root so many words before its own.
        """
        n, ahead = len(word), self.window - 1
        lanes = -(-n // LANE)
        padded = np.full(lanes * LANE + ahead, -1, np.int32)
        padded[ahead : ahead + n] = word
        state = np.zeros(lanes, np.int32)
        out = np.empty((LANE, lanes), np.int32)
        for k in range(LANE + ahead):
            state = self._step(state, padded[k : k + (lanes - 1) * LANE + 1 : LANE])
            if k >= ahead:
                out[k - ahead] = state
        return out.T.ravel()[:n]

    def matches(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, past the last and number in ``ends`` of every window's occurrences.

        Runs of the items' words that are shorter than the shortest window hold none and are left out of the scan.
        """
        if not len(self.ends):
            return (np.empty(0, np.int64),) * 3
        runs = np.flatnonzero(np.diff(np.concatenate(([False], word >= 0, [False])))).reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= np.searchsorted(self.first, self.ends[0], "right") - 1]
        step = np.zeros(len(word) + 2, np.int8)
        step[runs[:, 0]] += 1
        step[runs[:, 1] + 1] -= 1  # one word past each run stays, to part it from the next
        place = np.flatnonzero(np.cumsum(step, dtype=np.int8)[:-1])
        state = self.states(np.append(word, -1)[place])
        last = np.flatnonzero(state >= self.first[self.window])
        node = state[last]
        if len(self.short):
            at = np.flatnonzero(self.short[state])
            here = state[at]
            while len(at):
                over = np.searchsorted(self.ends, here).clip(max=len(self.ends) - 1)
                hit = (self.ends[over] == here) & (here < self.first[self.window])
                last, node = np.append(last, at[hit]), np.append(node, here[hit])
                here = self.fail[here]
                go = self.short[here]
                at, here = at[go], here[go]
        length = np.searchsorted(self.first, node, "right") - 1
        last = place[last]
        return last + 1 - length, last + 1, np.searchsorted(self.ends, node)


MAGIC = b"words-ac"


class _Scanner:
    """The automaton of one broadcast and its words' numbers, once a worker.

    The arrays are mapped from the file in which an executor keeps the broadcast, so its workers share them and only what
    is looked at takes memory; where the file can't be read as it is, the worker reads its own copy.
    """

    held: tuple[str, _Scanner] | None = None

    def __init__(self, shared: Broadcast):
        path, data = getattr(shared, "_path", None), None
        if path and os.path.exists(path):
            with open(path, "rb") as f:
                place = f.read(256).find(MAGIC)
            if place >= 0:
                data = np.memmap(path, np.uint8, "r", offset=place)
        self.automaton = Automaton.unpack(np.frombuffer(shared.value, np.uint8) if data is None else data)
        self.number = self.automaton.numbers() | {BETWEEN: -2}

    @classmethod
    def of(cls, shared: Broadcast) -> _Scanner:
        if cls.held is None or cls.held[0] != shared._path:
            cls.held = shared._path, cls(shared)
        return cls.held[1]


def scan(texts: list[bytes], automaton: Automaton, number: dict[bytes, int]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, the hit runs of words as (first, past the last), and the items with occurring windows."""
    tokens = (b" " + BETWEEN + b" ").join(map(normalise, texts)).split()
    word = np.fromiter(map(number.get, tokens, itertools.repeat(-1)), np.int32, len(tokens))
    stop = np.append(np.flatnonzero(word == -2), len(word))
    start = np.append(0, stop[:-1] + 1)
    first, past, which = automaton.matches(word)
    step = np.zeros(len(word) + 2, np.int64)
    np.add.at(step, first + 1, 1)
    np.add.at(step, past + 1, -1)
    edge = np.flatnonzero(np.diff(np.cumsum(step) > 0))
    runs = edge.reshape(-1, 2)
    run_of = np.searchsorted(stop, runs[:, 0])
    pairs = np.unique(np.searchsorted(stop, first) << 32 | which)
    text_of, which = pairs >> 32, pairs & 0xFFFFFFFF
    for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        lo, hi = np.searchsorted(run_of, [i, i + 1])
        if lo == hi:
            yield b - a, [], []
            continue
        ends = which[slice(*np.searchsorted(text_of, [i, i + 1]))]
        owners = np.unique(np.concatenate([automaton.owner[automaton.at[e] : automaton.at[e + 1]] for e in ends.tolist()]))
        yield b - a, [(x - a, y - a) for x, y in runs[lo:hi].tolist()], owners.tolist()


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the last of every word, in the text as it was."""
    inside = np.concatenate(([False], np.frombuffer(normalise(text), np.uint8) != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``, then n_words long, n_hit long, item_ids (array of the items' type of id), spans array<struct<start, stop>>, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Every
    document word inside any occurrence is hit. ``spans`` are the hit runs as byte offsets in the text as it was.
    Null texts have no words; items without id or text have no windows; an empty benchmark hits nothing; texts of one
    item id are all that item's; repeated rows give repeated rows; clashing columns with these names are replaced.

    The driver builds one automaton of all items, of 12 bytes a run of words: about 120 a word of the benchmark, 800 a
    word while it builds. An executor's workers share its pages.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ["n_words", "n_hit", "item_ids", "spans", "contaminated"]
    docs = docs.drop(*own)
    at = docs.columns.index(text_col)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    items = rows.distinct().toArrow()
    id_type = to_arrow_type(rows.schema["item"].dataType)
    ids = spark.sparkContext.broadcast(items["item"].to_pylist())
    shared = spark.sparkContext.broadcast(Automaton.of(items["text"].to_pylist(), window).pack())
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner.of(shared)
        for batch in batches:
            n_words, n_hit, found, spans = [], [], [], []
            for _, texts in text_slices(batch.column(at), BATCH_BYTES):
                for text, (n, runs, owners) in zip(texts, scan(texts, scanner.automaton, scanner.number), strict=True):
                    n_words.append(n)
                    n_hit.append(sum(b - a for a, b in runs))
                    found.append(sorted({ids.value[i] for i in owners}))
                    first, past = word_offsets(text) if runs else (None, None)
                    spans.append([{"start": int(first[a]), "stop": int(past[b - 1])} for a, b in runs])
            more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(id_type)), pa.array(spans, pa.list_(span)), pa.array([n > 0 for n in n_hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *own])

    return docs.mapInArrow(run, f"{kinds}, n_words long, n_hit long, item_ids array<{rows.schema['item'].dataType.simpleString()}>, spans array<struct<start: long, stop: long>>, contaminated boolean")


def digest(df: DataFrame) -> DataFrame:
    """The items as a count and a hash: ids sorted as strings, joined by commas."""
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return df.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def digest_of(ids: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
),
found AS (SELECT doc_id, n, p, item_id FROM places JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

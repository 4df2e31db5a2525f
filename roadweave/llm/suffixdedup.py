"""Removal of bytes that repeat an earlier string, exact over all documents, by suffix arrays of shards that hold all copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, bounded_batches, checkpointed, join_by_hot_key, stored, text_slices
from .suffix_array import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, and of the grams from which a string's anchor is picked.
LENGTH, GRAM = 100, 32
#: Bytes of one suffix array, and units of one anchor beyond which its strings are compared by their hashes instead.
SHARD_BYTES, HOT_UNITS = 1 << 20, 20_000
#: First rows of units that are held to be told apart; beyond, an anchor's units go out untold.
HELD_UNITS = 400_000


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position."""
    h, size, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base % 2**64
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return h | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _parts(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Three 21-bit hashes of the bytes that all strings share whose anchor stands in one third of the places; 0 for a third without strings.

    Two units share a string only if they share one of the three, so this tells most units apart that share no more than
    an anchor; a chance match costs a look only.
    """
    n, base = len(data), 0x9E3779B97F4A7C15
    power = _powers(base, n)
    back = _powers(pow(base, -1, 2**64), n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    out = np.zeros(len(at), np.uint64)
    for q in range(3):
        low, high = q * 23, q * 23 + 22
        some = (at - last <= high) & (at - first >= low)
        x, y = np.where(some, at - low, 0), np.where(some, at - high + LENGTH, 0)
        h = (total[y] - total[x]) * back[x]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out |= np.where(some, np.maximum(h >> np.uint64(43), np.uint64(1)), np.uint64(0)) << np.uint64(21 * q)
    return out


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of anchors, first and last start of the strings that are theirs.

    A ``valid`` string's anchor is its leftmost gram of smallest hash. Equal strings have equal anchors at equal places, so
    they meet under them; each string has one anchor only, so no string is looked at twice.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none.view(np.uint64), none, none
    h, width = _grams(data), LENGTH - GRAM + 1
    least = np.where(valid[: len(h) - width + 1], _sliding(h, width, np.minimum), np.uint64(0))
    # Neighbouring strings with one anchor are a run of one value.
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    some = least[first] > 0
    first, last = first[some], last[some]
    pad = np.zeros(width - 1, np.uint64)
    grams = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    if not len(first):
        return none, none.view(np.uint64), none, none

    def leftmost(start: np.ndarray) -> np.ndarray:
        k = np.searchsorted(grams, start)
        wrong = np.arange(len(k))
        while len(wrong := wrong[h[grams[k[wrong]]] != least[start[wrong]]]):
            k[wrong] += 1
        return grams[k]

    at = leftmost(first)
    # A gram that stands again before the run ends parts it: those runs are taken a string at a time.
    split = last > at
    if split.any():
        starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[split].tolist(), last[split].tolist(), strict=True)])
        at = np.concatenate([at[~split], leftmost(starts)])
        first, last = np.concatenate([first[~split], starts]), np.concatenate([last[~split], starts])
        order = np.lexsort((first, at))
        at, first, last = at[order], first[order], last[order]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at, first, last = at[new], first[new], last[np.append(new[1:], len(at)) - 1]
    return at, h[at], first, last


#: Slots in which a task keeps the units that it has seen, to send only the first of many equal ones.
SEEN = 1 << 19


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, unit (a hash of the bytes that its strings span), parts, place (where that starts, times 256, and its size), doc, sub.

    Neighbouring rows mostly have one doc, sub and upper half of a place: as they stand side by side they take little room in the shuffle.
    A unit that an earlier row of the same task has already is a repeat for certain: its place is given inverted. So of a
    unit that is everywhere a task sends about one row to the task of its anchor.
    """
    seen = np.zeros((4, SEEN), np.int64)
    for batch in batches:
        ids, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for first, texts in text_slices(batch.column(2)):
            whole = b"".join(texts)
            data = np.frombuffer(whole, np.uint8)
            size = np.array([len(t) for t in texts], np.int64)
            stop = np.cumsum(size)
            start = stop - size
            long = size >= LENGTH
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, start[long], 1)
            np.add.at(step, stop[long] - LENGTH + 1, -1)
            valid = np.cumsum(step[:-1]) > 0
            # A text beyond a chunk is taken in pieces that overlap by a string less a byte, so each string is in one of them.
            for a in range(0, len(data), CHUNK_BYTES):
                b = min(len(data), a + CHUNK_BYTES + LENGTH - 1)
                at, h, lo, hi = anchors(data[a:b], valid[a:b])
                if not len(at):
                    continue
                doc = np.searchsorted(stop, at + a, "right")
                parts = _parts(data[a:b], at, lo, hi)
                size = hi - lo + LENGTH
                unit = np.fromiter((xxhash.xxh3_64_intdigest(whole[x : x + n]) for x, n in zip((lo + a).tolist(), size.tolist(), strict=True)), np.uint64, len(at))
                place = (lo + a - start[doc]) * 256 + size
                docs, sub = ids[first + doc], subs[first + doc]
                again = _repeats(h, unit, docs, sub, place, seen)
                # What is known to repeat goes through under an anchor of chance, so a unit that is everywhere makes no hot task.
                chance = ((docs[again] ^ sub[again]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place[again].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
                h[again], place[again] = chance, ~place[again]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), unit.view(np.int64), parts.view(np.int64), place, docs, sub)], names=["anchor", "unit", "parts", "place", "doc", "sub"])


def _repeats(anchor: np.ndarray, unit: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows whose unit another row has in a smaller document or earlier in the same one: what a shuffle would find, found before it.

    ``seen`` holds, a slot a unit, the key, doc, sub and place of units from before; the least of this run's are put there.
    """
    key = anchor ^ (unit * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)]
    some = some[np.lexsort((place[some], sub[some], doc[some], unit[some], anchor[some]))]
    new = np.append(True, (anchor[some][1:] != anchor[some][:-1]) | (unit[some][1:] != unit[some][:-1]))[: len(some)]
    lead = some[np.flatnonzero(new)][np.cumsum(new) - 1] if len(some) else some
    again = np.zeros(len(key), bool)
    again[some[(doc[some] != doc[lead]) | (sub[some] != sub[lead]) | (place[some] != place[lead])]] = True
    rest = np.flatnonzero(~again)
    slot = (key[rest] >> np.uint64(20)).astype(np.int64) & (SEEN - 1)
    k, d, s, p = (x[slot] for x in seen)
    known = k == key[rest].view(np.int64)
    later = (doc[rest] > d) | ((doc[rest] == d) & ((sub[rest] > s) | ((sub[rest] == s) & (place[rest] > p))))
    again[rest[known & later]] = True
    put = ~(known & later)
    seen[:, slot[put]] = key[rest[put]].view(np.int64), doc[rest[put]], sub[rest[put]], place[rest[put]]
    return np.flatnonzero(again)


def _sharing(group: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which units share one of their three parts with another unit of their anchor."""
    out = np.zeros(len(group), bool)
    for q in range(3):
        part = parts.view(np.uint64) >> np.uint64(21 * q) & np.uint64(0x1FFFFF)
        some = np.flatnonzero(part)
        _, which, times = np.unique(group[some].astype(np.uint64) << np.uint64(21) | part[some], return_inverse=True, return_counts=True)
        out[some[times[which] > 1]] = True
    return out


def _spans_and_requests(most: int):
    """From rows sorted by anchor, unit, doc, sub, place: units that repeat an earlier one whole, as spans without anchor; and
    the first of each unit, with the anchor, if it may share a string with another unit of its anchor.

    Of the anchor at a batch's end the units' first rows are held until it ends; beyond ``most`` they go out as they
    come, and untold apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.empty((0, 6), np.int64)
        hot: int | None = None  # the anchor whose units go out as they come

        def out(rows: np.ndarray, asked: bool) -> pa.RecordBatch:
            at, size = rows[:, 4] >> 8, rows[:, 4] & 255
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0], mask=np.full(len(rows), not asked)), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(at), pa.array(at + size)], names=["anchor", "doc", "sub", "start", "stop"])

        def closed(firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """First rows of units whose anchors are over."""
            if len(firsts) < 2:
                return
            group = np.cumsum(np.append(False, firsts[1:, 0] != firsts[:-1, 0]))
            several = np.bincount(group)[group] > 1
            firsts, group = firsts[several], group[several]
            asked = firsts[_sharing(group, np.ascontiguousarray(firsts[:, 5]))]
            if len(asked):
                yield out(asked, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
            known = rows[:, 4] < 0
            if known.any():
                found = rows[known]
                found[:, 4] = ~found[:, 4]
                yield out(found, False)
                rows = rows[~known]
            if not len(rows):
                continue
            n = len(held)
            rows = np.concatenate([held, rows])
            new_anchor = np.append(True, rows[1:, 0] != rows[:-1, 0])
            new_unit = new_anchor | np.append(True, rows[1:, 1] != rows[:-1, 1])
            firsts = np.flatnonzero(new_unit)
            rep = rows[firsts[np.cumsum(new_unit) - 1]]
            # A row of the same place is the same unit, of a repeated row; not a repeat.
            again = ~new_unit & (rows[:, 2:5] != rep[:, 2:5]).any(axis=1)
            again[:n] = False
            if again.any():
                yield out(rows[again], False)
            last = rows[-1, 0]
            if hot is not None and n:
                # Of a hot anchor only the last unit's first row was held, to know its repeats; it is out already.
                mine = firsts[(firsts >= n) & (rows[firsts, 0] == hot)]
                if len(mine):
                    yield out(rows[mine], True)
                firsts = firsts[rows[firsts, 0] != hot] if last != hot else firsts[-1:]
            if hot is not None and last == hot:
                held = rows[firsts]
                continue
            hot = None
            first_rows = rows[firsts]
            over = first_rows[:, 0] != last
            yield from closed(first_rows[over])
            held = first_rows[~over]
            if len(held) > most:
                yield out(held, True)
                hot, held = int(last), held[-1:]
        if hot is None:
            yield from closed(held)

    return run


def _cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text, doc, sub, units = (batch.column(k)[i].as_py() for k in range(4))
            for lo in range(0, len(units), 10_000):
                part = units[lo : lo + 10_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([u["anchor"] for u in part], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([sub] * n, pa.int64()), pa.array([u["start"] for u in part], pa.int64()), pa.array([text[u["start"] : u["stop"]] for u in part], pa.binary())], names=["anchor", "doc", "sub", "start", "bytes"])


def repeated_in(docs: np.ndarray, starts: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, stop) of the strings of 100 bytes that also start earlier within these units, by one suffix array."""
    size = np.array([len(u) for u in units], np.int64)
    # UTF-8 has no byte 255 or 254: the first ends each unit, so no string that fits a unit holds it.
    data = np.frombuffer(b"\xff".join(units) + b"\xff\xfe", np.uint8)
    symbols = data.astype(np.uint16) + 1
    symbols[-1] = 0
    sa = suffix_array(symbols, 257)
    prefix = permuted_prefixes(data, sa, LENGTH)
    base = np.cumsum(size + 1) - size - 1
    unit = np.searchsorted(base, sa, "right") - 1
    fits = sa - base[unit] + LENGTH <= size[unit]
    group = np.cumsum(prefix[sa] < LENGTH)[fits]
    unit, place = unit[fits], sa[fits]
    doc, start = docs[unit], starts[unit] + place - base[unit]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    first = np.append(True, group[1:] != group[:-1])[: len(group)]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[lead]) | (start != start[lead])
    return merged(doc[later], start[later], start[later] + LENGTH)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # Running maxima of stops, a document at a time: documents are lifted above each other by an offset.
    rank = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    lift = rank * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a shard closes at the first change of anchor after SHARD_BYTES."""
    hold: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        _, doc, sub, start, units = zip(*hold, strict=True)
        # Documents by their rank: by id, then by their text's hash.
        names, rank = np.unique(np.array([doc, sub], np.int64).T, axis=0, return_inverse=True)
        which, first, last = repeated_in(rank.ravel(), np.array(start, np.int64), list(units))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[which, 0], names[which, 1], first, last)], names=["doc", "sub", "start", "stop"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_BYTES and row[0] != hold[-1][0]:
                yield flush()
                hold, size = [], 0
            hold.append(row)
            size += len(row[4])
    if hold:
        yield flush()


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, doc, sub, start, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(unit) - LENGTH + 1
            if n > 0:
                keys = [xxhash.xxh3_128_digest(unit[i : i + LENGTH]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([sub] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())], names=["string", "doc", "sub", "start"])


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column(1).fill_null(b"").to_pylist()
        for text, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
            s = np.array([(0, x["start"], min(x["stop"], len(text))) for x in spans or () if x["start"] < len(text)], np.int64).reshape(-1, 3)
            _, start, stop = merged(s[:, 0], s[:, 1], s[:, 2])
            kept = [text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)], strict=True)]
            rows.append((len(text), int((stop - start).sum()), [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)], b"".join(kept)))
        n, removed, spans, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_units: int = HOT_UNITS) -> DataFrame:
    """id, n_bytes, n_removed, spans array<struct<start, stop>> (the maximal removed runs), kept binary: the rest.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of smaller id, or earlier in
    its own. Null texts are empty; rows without id are left out; rows that repeat an id and text are one document, given
    back as often; rows of one id with different texts are documents of their own, in the order of their texts' hashes;
    an empty table gives none; other columns play no part.

    Only anchors (about one position in 35) are shuffled, never all positions. All copies of a string meet under its
    anchor; a unit, the run of strings that one anchor has, whose bytes all stand earlier is removed whole, and what is left, first copies that share an anchor
    but not all bytes, goes to suffix arrays of about SHARD_BYTES. An anchor with more than ``hot_units`` such units
    has its strings dealt by 128-bit hashes, aggregated before the shuffle, instead of one shard. Texts are shuffled once.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Only a table in which an id stands twice needs the texts' hashes; else they are 0, which takes no room.
    repeated = df.select(F.col(id_col).cast("long").alias("doc")).where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").limit(1)
    once, none = repeated.isEmpty(), F.lit(0).cast("long")
    sub = none if once else F.xxhash64(text)
    # The constant is no key: the optimizer folds it in a join's keys, which then are not those that the texts were dealt by,
    # and all texts would be shuffled again.
    key = ["doc"] if once else ["doc", "sub"]
    docs = df.select(F.col(id_col).cast("long").alias("doc"), sub.alias("sub"), text.cast("binary").alias("text")).where("doc IS NOT NULL")
    rows = docs.mapInArrow(_anchor_rows, "anchor long, unit long, parts long, place long, doc long, sub long")
    sorted_rows = rows.repartition("anchor").sortWithinPartitions("anchor", "unit", "doc", "sub", "place").select("anchor", "unit", "doc", "sub", "place", "parts")
    found = stored(sorted_rows.mapInArrow(_spans_and_requests(max(hot_units, HELD_UNITS)), "anchor long, doc long, sub long, start long, stop long"))
    spans = found.where("anchor IS NULL").select("doc", "sub", "start", "stop")
    asked = found.where("anchor IS NOT NULL")
    hot = checkpointed(asked.groupBy("anchor").count().where(F.col("count") > hot_units).select("anchor"))
    by_doc = docs.select(*key, "text").repartition(*key)
    requests = asked.groupBy(*key).agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("units"))
    # Lists are larger than the stored rows, whose size would have them broadcast.
    units = by_doc.join(requests.hint("merge"), key).select("text", "doc", none.alias("sub") if once else "sub", "units").mapInArrow(_cut_units, "anchor long, doc long, sub long, start long, bytes binary")
    common = units
    if not hot.isEmpty():
        common = units.join(hot, "anchor", "left_anti")
        strings = units.join(hot, "anchor", "left_semi").select("anchor", "doc", "sub", "start", "bytes").mapInArrow(_string_rows, "string binary, doc long, sub long, start long")
        least = strings.groupBy("string").agg(F.min(F.struct("doc", "sub", "start")).alias("least"), F.count("*").alias("n"))
        later = join_by_hot_key(strings, checkpointed(least.where("n > 1")), "string", "n").where(F.struct("doc", "sub", "start") > F.col("least"))
        spans = spans.union(later.select("doc", "sub", "start", (F.col("start") + LENGTH).alias("stop")))
    shards = common.select("anchor", "doc", "sub", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.union(shards.mapInArrow(_shard_spans, "doc long, sub long, start long, stop long"))
    removals = spans.groupBy(*key).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = by_doc.join(removals, key, "left").select("doc", "text", "spans").mapInArrow(_cut_text, "doc long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.withColumnRenamed("doc", id_col)


#: Every string of 100 bytes, in hexadecimal, and the runs that all but each one's first cover.
SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
pieces AS (SELECT doc_id, k * 1000 AS base, substr(h, 2000 * k + 1, 2198) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d WHERE len(h) >= 200)),
strings AS (SELECT doc_id, base + i AS start, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, base, h, unnest(range(0, least(1000, len(h) // 2 - 99))) AS i FROM pieces)),
later AS (SELECT doc_id, start FROM strings QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, start) > 1),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS new FROM later)),
spans AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM islands GROUP BY doc_id, island),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id, h),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY before) AS rest, sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM d JOIN kept USING (doc_id)
"""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from roadweave.llm import mixing
from roadweave.llm.queries import op12_source_mixing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, size string, slot int"


def brute_targets(size, weight, most=3):
    """By the rule: share, stop what is above, reshare the excess."""
    target, stopped = {}, set()
    while True:
        left, w = sum(size.values()) - sum(most * size[s] for s in stopped), sum(weight[s] for s in size if s not in stopped)
        target = {s: Fraction(most * size[s]) if s in stopped else Fraction(left * weight[s], w) for s in size}
        more = {s for s in size if s not in stopped and target[s] > most * size[s]}
        if not more:
            return {s: float(t) for s, t in target.items()}
        stopped |= more


def brute(rows, block=64, most=3):
    """The mix word by word: every slot in turn takes its source's next block."""
    n_words = lambda t: len((t or "").translate({c: 32 for c in range(9, 14)}).split(" ")) - (t or "").translate({c: 32 for c in range(9, 14)}).split(" ").count("")
    docs = [(i, s, n_words(t), hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest(), k) for k, (i, t, s) in enumerate(rows)]
    names = sorted({s for _, s, *_ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target = brute_targets(size, weight, most) if sum(size.values()) else dict.fromkeys(names, 0.0)
    blocks = {s: -(-size[s] // block) for s in names}
    need = {s: round(target[s] * blocks[s] / size[s] * 65536) if size[s] else 0 for s in names}
    total, low, edges = sum(need.values()), 0, []
    for s in names:
        edges.append(((low << 60) // total if total else 0, ((low + need[s]) << 60) // total if total else 0, s))
        low += need[s]
    stream = {s: [d[4] for d in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[2])) for _ in range(d[2])] for s in names}
    at, taken = Counter(), Counter()
    for i in range(-(-total // 65536)):
        u = i * mixing.GOLDEN % 2**60
        s = next(s for a, b, s in edges if a <= u < b)
        if at[s] < most * blocks[s]:
            j, (q, r) = at[s] % blocks[s], divmod(size[s], blocks[s])
            taken.update(stream[s][j * q + min(j, r) : (j + 1) * q + min(j + 1, r)])
            at[s] += 1
    return [(i, n, size[s], target[s], taken[k]) for i, s, n, _, k in docs], names


def sample(seed):
    rng = random.Random(seed)
    of = lambda n: " ".join("w" for _ in range(n))
    rows = [(i, of(rng.choice([0, 1, 5, 40, 200])), "big" if i % 3 == 0 else rng.choice(["a", "b", None, "zé", "\U0001f600", "￮"])) for i in range(150)]
    rows += [(400, of(9000), "long"), (401, None, "b"), (402, "\t\n  ", "empty"), (403, "one", "tiny")]
    return rows + [(7, "two words", "a")] * 3 + [(None, "no id", "a"), (7, "quite another text", "a")]


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 7)])
def test_mix_equals_slot_by_slot(spark, seed, block):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = mixing.mix(df, block=block)
    want, names = brute(rows, block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    out = sorted((tuple(r) for r in got.documents.select("id", "size", "source_size", "target", "taken").collect()), key=key)
    assert [(a, b, c, e) for a, b, c, _, e in out] == [(a, b, c, e) for a, b, c, _, e in sorted(want, key=key)]
    assert [r[3] for r in out] == pytest.approx([r[3] for r in sorted(want, key=key)], rel=1e-12)
    assert all(r[4] <= 3 * r[1] for r in out)
    order = got.sources.orderBy("s").collect()
    assert [r.source for r in order] == names and [r.s for r in order] == list(range(len(names)))


def test_sources_come_near_their_targets_all_along(spark):
    """So in all, and in every stretch of the schedule, whose slots hold pieces of blocks of equal words."""
    m = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    got = m.documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 4 * mixing.BLOCK for r in got) and sum(r.taken for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.01)
    pieces = mixing.mixture(m).orderBy("slot").collect()
    by_slot = defaultdict(int)
    for r in pieces:
        by_slot[r.slot] += r.words
    assert max(by_slot.values()) <= mixing.BLOCK
    slots, total = max(by_slot) + 1, sum(r.target for r in got)
    for part in range(8):
        here = Counter()
        for r in pieces:
            if slots * part // 8 <= r.slot < slots * (part + 1) // 8:
                here[r.source] += r.words
        assert all(abs(here[r.source] / sum(here.values()) - r.target / total) < 0.01 for r in got)


def test_reruns_agree(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in sample(3)], SCHEMA)
    first = sorted(map(str, mixing.mix(df).documents.collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(str, mixing.mix(df.repartition(7, "text")).documents.collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).documents.count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "x", 1), (2, "", "a", "x", 1)], SCHEMA)).documents.collect()
    assert sorted((r.id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op12_source_mixing(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(mixing.sql()).fetchall())

import unicodedata
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from roadweave.llm import langid
from roadweave.llm.queries import op10_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = dict(duckdb.connect().execute(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = op10_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def grams_of(text):
    """(length, n-gram) of all words' letters, a blank at each end, by slicing."""
    out = []
    spaced = "  " + "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()) + "  "
    for n in langid.ORDERS:
        out += [(n, spaced[i : i + n]) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1 : i + n - 1]]
    return out


def test_query_matches_brute_force(spark):
    """Counts, rates and shares in dictionaries, membership in sets: the query differs by the filter's chance hits only."""
    sf = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute(f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()
    counts = {}
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2 and text is not None and lang is not None:
            for g in grams_of(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {(k, n): sum(c for g, c in v.items() if g[0] == n) for k, v in counts.items() for n in langid.ORDERS}
    rate = {k: {g: c / total[k, g[0]] for g, c in v.items()} for k, v in counts.items()}
    held = {k: {g for g, r in v.items() if r >= langid.SHARE * max(o.get(g, 0) for o in rate.values())} for k, v in rate.items()}
    got = {r.doc_id: r for r in op10_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        grams = grams_of(text or "")
        share = {k: sum(g in v for g in grams) / max(1, len(grams)) for k, v in held.items()}
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert got[d].lang_pred == "und" and got[d].score == 0
            continue
        best, second, *_ = sorted(share.values(), reverse=True)
        assert abs(got[d].score - best) < 0.02
        if best - second > 0.02:
            assert share[got[d].lang_pred] == best


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


ROWS = [(i, f"the cat and the dog {w}", "en", "x") for i, w in enumerate("abcd")] + [(10 + i, f"der hund und die katze {w}", "de", "x") for i, w in enumerate("abcd")]


def test_counts_match_brute_force(spark):
    model = langid.train(docs(spark, ROWS))
    assert model.languages == ["de", "en"]
    text = "The Dog & die Katze -- x"
    grams = [" ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""])]
    want = sum(1 for n in langid.ORDERS for i in range(len(grams[0]) - n + 1) if grams[0][i + 1 : i + n - 1].isalpha())
    assert model.counts([text])[0].tolist() == [want]
    assert model.predict(["the dog", "die katze", "THE CAT"])[0] == ["en", "de", "en"]


def test_nulls_repeats_long_and_empty(spark):
    model = langid.train(docs(spark, ROWS))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "123 !?", None, "a"), (4, "q", None, "a"), (5, "the cat " * 60_000, None, "a"), (5, "the cat", None, "a"), (None, "die katze", None, None)]
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs(spark, rows), model).collect()]
    assert [g for _, g in got[:3]] == ["und"] * 3 and got[3][1] in model.languages
    assert got[4:] == [(5, "en"), (5, "en"), (None, "de")]
    assert langid.identify(docs(spark, rows).where(F.lit(False)), model).count() == 0


def test_without_labels_and_with_many_languages(spark):
    none = langid.train(docs(spark, [(1, "a b", None, "x")]))
    assert none.predict(["abc"])[0] == ["und"]
    words = {f"l{i:03d}": np.array([h for h, ok in zip(*next(langid.ngrams([chr(0x4E00 + 9 * i) * 3], (3,)))[:2], strict=True) if ok], np.uint64).view(np.int64) for i in range(130)}
    model = langid.Model.of(words, (3,))
    assert model.predict([chr(0x4E00 + 9 * i) * 3 for i in range(130)])[0] == sorted(words)

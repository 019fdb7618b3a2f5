"""Periodic runs against comparing all places for every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.llm import periodic
from featloom.llm.base import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least_words=6, least_periods=4):
    found = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least_words, least_periods * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(90))]
    if rng.random() < 0.6:
        period = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        words[3:3] = period * rng.randrange(1, 9) + period[: rng.randrange(len(period))]
    return words


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (10, 3)])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 50)
    rng = random.Random(least[0])
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 8))]
        got = periodic.runs_of([np.array(t, np.int64) for t in texts], *least)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t, *least)]


def test_common_extensions_of_covered_places():
    rng = np.random.default_rng(4)
    for words in (rng.integers(0, 2, 200), np.zeros(150, np.int64), np.tile(rng.integers(0, 3, 11), 20)):
        extend = periodic.Extender(np.concatenate([words, [-2]]))
        i, j = rng.integers(0, len(words), (2, 400))
        i, j = i[i != j], j[i != j]
        whole = [*words.tolist(), -2]
        for a, b, got in zip(i.tolist(), j.tolist(), extend(i, j).tolist(), strict=True):
            want = 0
            while max(a, b) + want < len(whole) and whole[a + want] == whole[b + want]:
                want += 1
            assert got == want


def test_long_and_periodic_texts():
    assert periodic.runs_of([np.zeros(50_000, np.int64)]).tolist() == [[0, 0, 50_000, 1]]
    assert periodic.runs_of([np.arange(50), np.tile(np.arange(1000), 40)]).tolist() == [[1, 0, 40_000, 1000]]
    assert periodic.runs_of([np.array([1, 2] * 10 + [3] * 6)]).tolist() == [[0, 0, 20, 2], [0, 20, 6, 1]]


def test_frame_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "PASS_WORDS", 100)
    rng = random.Random(9)
    rows = [(i, "  ".join(f"w{x}" for x in random_words(rng))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "a " * 9), (3, rows[3][1]), (103, "é x " * 8 + "\x0bend")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).repartition(3)
    got = periodic.periodic_runs(frame).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        words = WORD.findall(by[r["key"]] or "")
        runs = brute(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words) and r["collapsed"] == collapsed(words, runs)
    assert periodic.periodic_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(frame, least_periods=1)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_periodic_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c in ("n_runs", "start", "length", "period", "exponent_milli")} == {"bigint"}
    rows = got.collect()
    assert len(rows) == len(texts)
    met = 0
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            met += 1
        # The plain comparison is quadratic: very long texts are compared where they repeat only.
        if n > 3000 and h % 10:
            continue
        runs = brute(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert met > 5

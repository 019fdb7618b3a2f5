"""Language identification, toxicity and URL filter: held-out accuracy, calibration and defined cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from featloom.llm import language, toxicity, urls
from featloom.llm.base import QUERIES

SF = "/root/testdata/sf0.001"


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert held[0] > 0.98 and held[1] > 200 and 0 <= held[2] and held[3] <= 1


def test_language_defined_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_languages(docs)
    assert set(model.within) == {"germanic", "romance"} and model.within["germanic"].classes == ["de", "en"]
    german = docs.where("lang = 'de'").orderBy(F.length("text").desc(), "doc_id").first()["text"]
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !! \n", "x"), (4, german * 200, "x"), (4, "a", None)], "doc_id long, text string, lang_score string")
    rows = language.identified(odd, model).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["lang_score"] for r in rows[:3]] == [0.0] * 3 and len(rows) == 5
    assert rows[3]["lang_pred"] == "de"
    none = language.identified(odd, language.fit_languages(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = language.fit_languages(docs.where("lang = 'fr'"))
    assert {(r["lang_pred"], r["lang_score"]) for r in language.identified(odd, one).where("doc_id = 4").collect()} == {("fr", 1.0)}
    kept = language.accepted(docs.union(spark.createDataFrame([(900, docs.first()["text"], None), (901, "77", "en")], docs.schema)))
    ids = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert 901 not in ids and ids[900] == docs.first()["lang"] and len(ids) == docs.count() + 1
    assert language.accepted(docs.limit(0)).count() == 0


def test_copies_do_not_change_the_languages_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").distinct()
    few = docs.where("lang = 'fr'").orderBy("text").limit(3).cache()
    rest = docs.where("lang <> 'fr'")
    bare = language.fit_languages(rest.union(few), rows=40)
    copies = few.crossJoin(spark.range(2_000)).select("text", "lang")
    numbers = spark.range(2_000).select(F.col("id").cast("string").alias("text"), F.lit("fr").alias("lang"))
    hot = rest.orderBy("text").limit(1).crossJoin(spark.range(3_000)).select("text", "lang")
    model = language.fit_languages(rest.union(copies).union(numbers).union(hot).repartition(7), rows=40)
    assert "fr" in model.within["romance"].classes
    assert model.families == bare.families and np.array_equal(model.root.weights, bare.root.weights)
    assert all(model.within[f].classes == w.classes and np.array_equal(model.within[f].weights, w.weights) for f, w in bare.within.items())


def test_separator_finds_the_margin():
    x = np.array([[0.0, 1], [0.2, 1.2], [0, -1], [0.3, -1.1]], np.float32)
    share = language.separator(x @ x.T + 1, np.array([1, 1, -1, -1]), penalty=1000.0, rounds=500)
    w = share @ x
    assert np.allclose(x @ w + share.sum(), [1, 1.2, -1, -1.1], atol=0.05) and abs(w[0]) < 0.15


def toxic_table(spark, n):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("na", "ro", "sti", "ven", "xu", "zi")]
    bad = [f"grob{e}" for e in ("o", "an", "ul", "ix", "et")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = rng.choices(words, k=rng.randrange(20, 200))
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), rng.choice(["xx", "yy"])))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_are_learned(spark):
    docs, labels = toxic_table(spark, 600)
    fitted = toxicity.fit_toxicity(docs.where("doc_id < 400"), labels.where("doc_id < 400"))
    found = toxicity.scored(docs.withColumn("score", F.lit("clash")).where("doc_id >= 400"), fitted).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in found]) > 0.97
    assert set(fitted.thresholds) <= {"xx", "yy"} and all(r["flagged"] == (r["score"] >= r["threshold"]) for r in found)
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "ba " * 60_000 + "grobo", "zz"), (3, "grobinski", "yy")], docs.schema)
    rows = toxicity.scored(odd, fitted).collect()
    assert len(rows) == 4 and rows[0]["score"] == rows[1]["score"] < 0.3 and rows[2]["score"] >= 0.3 and rows[3]["score"] >= 0.3
    bare = toxicity.scored(odd, toxicity.fit_toxicity(docs, labels.limit(0))).collect()
    assert len({r["score"] for r in bare}) == 1 and 0 <= bare[0]["score"] <= 1
    assert toxicity.scored(docs.limit(0), fitted).count() == 0


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 2_000)
    # More rows than the bounds of the old sample: each positive text has a word of its own group, clean ones are alike.
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ba do ki lu "), F.when(F.col("id") % 3 == 0, F.lit("grobo")).otherwise(F.lit("mena"))).alias("text"), F.lit("xx").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.labelled_words(docs.repartition(3), labels, "doc_id", "text", "lang", "toxic")
    assert rows.count() == 6_000 and rows.rdd.getNumPartitions() == 3
    used = rows.where("NOT held")
    counts, bucket = toxicity._bucket_counts(used), toxicity.buckets_of(b"grobo")[0]
    assert counts[1, bucket] == used.where("label = 1").count() and counts[0, bucket] == 0
    fitted = toxicity.Toxicity(rows, rounds=2)
    assert toxicity.scored(docs, fitted).where((F.col("score") >= 0.3) != (F.col("doc_id") % 3 == 0)).count() == 0
    scores = [(n, s, y) for n, part in (("", range(9)), ("xx", range(60))) for s, y in ((round(i / 60, 3), int(i % 7 > 2)) for i in part)]
    got = toxicity._thresholds(spark.createDataFrame(scores, "name string, score double, label int"))
    for name in ("", "xx"):
        own = sorted({s for n, s, _ in scores if n == name}, reverse=True)
        f1 = {s: 2 * sum(y for n, t, y in scores if n == name and t >= s) / (sum(n == name and t >= s for n, t, _ in scores) + sum(y for n, _, y in scores if n == name)) for s in own}
        best = max(own, key=lambda s: (f1[s], s))
        below = max((s for s in own if s < best), default=best)
        assert math.isclose(got[name], (best + below) / 2)


def test_pieces_of_a_long_text_score_like_the_whole():
    model = toxicity.Convolution()
    step = toxicity.PIECE - max(toxicity.WIDTHS) + 1
    for n in (3 * toxicity.PIECE + 17, 1, 2, step, step + 1, step + 2, step + 3, 2 * step + 1, 2 * step + 2):
        words = [b"w%d" % (i % 977) for i in range(n)]
        whole = model.pooled(model.products(np.array([toxicity.buckets_of(w) for w in words])))
        assert math.isclose(toxicity._margin(model, toxicity.WordRows(model), words), float(model.margin(whole)), rel_tol=1e-4)


def test_url_rules_and_parts(spark):
    cases = [
        ("http://A.Org/x/y?z", "a.org", "/x/y", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://m.example.org/en/12#t", "m.example.org", "/en/12", "example.org/en/1", "block"), ("http://m.example.org/en/2", "m.example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/q", "x.com", "/de/q", "com/de/", "block"), ("http://x.com/es/", "x.com", "/es/", None, None),
        ("http://org", "org", "", None, None), ("http://x.org?a/b", "x.org", "", None, None), ("x.org/a", "", "", None, None), (None, "", "", None, None),
        ("a://notorg/ü", "notorg", "/ü", None, None), ("u://ÄB.org/://q/", "Äb.org", "/://q/", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urls.judged(pages.union(pages.where("page_id = 0"))).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judged(pages.limit(0)).count() == 0


def brute_ratios(labelled, order, alphabet):
    """Witten-Bell mixtures counted in dictionaries: per run of `order` characters the log ratio."""
    chance = {}
    for verdict in ("allow", "block"):
        counts = {}
        for text, v in labelled:
            if v == verdict:
                padded = urls.START * (order - 1) + text
                for end in range(order - 1, len(padded)):
                    for k in range(order):
                        after = counts.setdefault(padded[end - k : end], {})
                        after[padded[end]] = after.get(padded[end], 0) + 1

        def p(run, counts=counts):
            lower = 1 / alphabet
            for k in range(order):
                seen = counts.get(run[order - 1 - k : order - 1], {})
                if seen:
                    lower = (seen.get(run[-1], 0) + len(seen) * lower) / (sum(seen.values()) + len(seen))
            return lower

        chance[verdict] = p
    return lambda run: math.log(chance["allow"](run)) - math.log(chance["block"](run))


def check_urls(rows, got, order):
    from zlib import crc32

    clean = {i: "".join(c.lower() if c.isascii() else c for c in u or "") for i, u in rows}
    labelled = [(clean[i], got[i]["verdict"]) for i, _ in rows if got[i]["rule"] and crc32(str(i).encode()) % 4 != 2]
    ratio = brute_ratios(labelled, order, len(set("".join(clean.values()))) + 1)
    padded = {i: urls.START * (order - 1) + t for i, t in clean.items()}
    score = {i: np.mean([ratio(padded[i][k : k + order]) for k in range(len(t))]) if t else 0.0 for i, t in clean.items()}
    assert all(abs(got[i]["log_ratio"] - s) < 2e-6 for i, s in score.items())
    allowed = [s for i, s in score.items() if not got[i]["rule"] and got[i]["verdict"] == "allow"]
    blocked = [s for i, s in score.items() if not got[i]["rule"] and got[i]["verdict"] == "block"]
    assert not allowed or not blocked or min(allowed) >= max(blocked) - 1e-6


def test_url_scores_equal_brute_force(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: r for r in QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    check_urls(rows, got, urls.ORDER)


def test_rare_runs_meet_their_ratios_in_a_shuffle(spark):
    rng = random.Random(7)
    ends = ["org/ä", "com/fr/b+~", "com/de/casino", "com/x@;", "net/ü,", ""]
    rows = [(i, f"HTTP://{rng.choice('abc')}{rng.randrange(30)}.{rng.choice(ends)}{rng.randrange(999)}") for i in range(160)] + [(900, ""), (901, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    # With a common share of a twentieth hardly a run is common.
    for order, common in ((4, 20), (1, 3)):
        got = {r["page_id"]: r for r in urls.judged(pages, order=order, common=common).collect()}
        assert len(got) == len(rows)
        check_urls(rows, got, order)

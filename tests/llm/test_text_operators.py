import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from deskgrain.llm import bpe, langid, mixing, quality
from deskgrain.llm.common import Memory

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Hello world! it's 2024"), (4, "Hello world! it's 2024"), (5, "a" * 5_000),
    (6, "日本語 — ñandú \U0001f600 " * 300), (7, " " * 3_000 + "x" + "-=" * 700),
]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(PATH, P.PATTERN).ranks, special_tokens={})


def test_bpe_is_the_library_s(spark, tik):
    d = spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, ids string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(d, PATH, P.PATTERN).collect()}
    for i, t in ODD:
        ids = tik.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_joining_random_halves(tik):
    b, rng = bpe.tokenizer(PATH, P.PATTERN), random.Random(3)
    for _ in range(400):
        data = "".join(rng.choices(rng.choice(["ab", "etaoin ", "   \n", "éàü", "0123", "xyz"]), k=rng.randint(2, 120))).encode()
        cut = rng.randint(1, len(data) - 1)
        assert b.join(b.tree(data[:cut]), b.tree(data[cut:])) == b.tree(data) == b.merge(data)


def test_ordinary_text_comes_through_the_tree(spark, tik):
    """Every match of more than a byte is joined of halves, and all documents agree with the library."""
    b = bpe.ByteBPE(bpe.tokenizer(PATH, P.PATTERN).ranks, P.PATTERN)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    distinct = {m for t in texts for m in b.find(t or "")}
    whole, merged = {m for m in distinct if len(m.encode()) > bpe.NODE}, b.merge
    sizes = []
    b.merge = lambda data: sizes.append(len(data)) or merged(data)
    for t in texts:
        ids = tik.encode_ordinary(t or "")
        assert b.encode(t or "") == ids and b.decode(tuple(ids)) == (t or "").encode()
    assert b.joins > len(whole) > 10_000
    assert len(sizes) < b.joins  # fewer windows than joins: what is known of two tokens serves again


def test_what_is_remembered_is_bounded():
    seen = []
    m = Memory(lambda k: seen.append(k) or (k,), size=3)
    for k in [1, 2, 1, 3, 4, 1, 5, 6, 1, 7]:
        assert (m.known(k) or m.find(k)) == (k,)
        assert len(m.young) <= 3 and len(m.old) <= 3
    assert seen.count(1) == 1


def test_columns_of_ids_round_trip(spark, tik):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = bpe.decode(bpe.encode(d, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == tik.encode_ordinary(r["text"] or "") for r in rows)


def test_bpe_of_nothing(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def waterfill(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", "é", "Z", None, "a", "a"])) for i in range(400)] + [
        (900, None, "b"), (901, "", "only"), (902, "again twice", "a"), (902, "again twice", "a"),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix_report(d).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = waterfill(sizes, (3, 1, 2), 1.5, 2.0), {}
    assert len(got) == len(rows)
    source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] in (0, r["size"], 2 * r["size"])
    by = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = by[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(d.repartition(7)).collect()), key=str)
    times = {r["doc_id"]: r["mix_times"] for r in mixing.mix(d).collect()}
    assert all(times[r["doc_id"]] == r["times"] for r in got)


def test_mixing_nothing(spark):
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.mix_report(
        spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    ).where("taken = 0 and target = 0").count() == 2


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(d, langid.fit(d)).withColumn("out", langid.held_out(F.col("doc_id")))
    r = found.where("out and length(text) >= 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 100 and r[0] >= 0.98
    assert found.where("lang_score < 0 or lang_score > 1").count() == 0


def test_language_of_odd_texts(spark):
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here " * 9, "en"), ("der Hund und die Katze sind hier " * 9, "de"), ("der Hund liegt nicht im Haus " * 900, "de"), (None, "en"), ("", None), ("123 !!", "de"), ("the end", "en"), ("das", "de")] * 6)], "doc_id long, text string, lang string")
    got = langid.identify(d, langid.fit(d)).orderBy("doc_id").limit(8).collect()
    assert [(r["lang_pred"], r["lang_score"]) for r in got[3:6]] == [("und", 0.0)] * 3
    assert [r["lang_pred"] for r in got[:3]] == ["en", "de", "de"] and got[1]["lang_score"] > 0.5
    none = d.limit(0)
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0


def test_quality_shrinks_and_separates(spark):
    good, bad = "a plain sentence of many different words stands here today", "### $$$ THE THE THE ### %%%"
    rows = [(i, good if i % 4 else bad, ["big", "small", None][min(2, i % 50 // 40 + (i % 50 == 49))], "p") for i in range(200)] + [
        (500, None, "new", None), (501, "", None, "x"), (7, good, "big", "p"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.assess(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert all(got[i]["kept"] == bool(i % 4) for i in range(150, 200))
    assert 0 < got[500]["path_share"] < 1 and got[500]["host_share"] == got[500]["path_share"]
    none = {r["doc_id"]: r["score"] for r in quality.assess(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()}
    assert none[1] == pytest.approx(0.5)
    assert quality.assess(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def brute_quality(rows, labels):
    """Evidence, shares and score of every row, one document at a time, its own label left out."""
    truth = {}
    for i, y in labels:
        if i is not None and y is not None:
            truth[i] = max(truth.get(i, 0), y)

    def features(text):
        hashed = {f for w in (text or "").encode().split() for f in quality.word_features(w)}
        return sorted(hashed)

    docs = [(i, features(t), h, p, truth.get(i)) for i, t, h, p in rows]
    known = [d for d in docs if d[4] is not None]

    def ratio(f, y):
        good = [d for d in known if d[4] == 1]
        bad = [d for d in known if d[4] == 0]
        g, b = sum(f in d[1] for d in good) - (y == 1), sum(f in d[1] for d in bad) - (y == 0)
        return np.log((g + 1) / (len(good) - (y == 1) + 2)) - np.log((b + 1) / (len(bad) - (y == 0) + 2))

    x = [np.mean([ratio(f, d[4]) for f in d[1]]) if d[1] else 0.0 for d in docs]
    shares = []
    for _, _, h, p, y in docs:
        own = [d for d in known]
        n, good = len(own) - (y is not None), sum(d[4] for d in own) - (y or 0)
        at_host = [d for d in own if d[2] == h]
        at_path = [d for d in at_host if d[3] == p]
        shares.append(
            (
                (good + 1) / (n + 2), sum(d[4] for d in at_host) - (y or 0), len(at_host) - (y is not None),
                sum(d[4] for d in at_path) - (y or 0), len(at_path) - (y is not None),
            )
        )
    return x, shares


def test_quality_against_brute_force(spark, monkeypatch):
    """Ratios and shares with each document's own label left out; the strengths are fixed, so that shares can be told apart."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocabulary[: 15 + 15 * (i % 2)], k=rng.randint(0, 12))), f"h{i % 3}", f"p{i % 4}" if i % 5 else None) for i in range(40)] + [
        (90, None, None, "p"), (5, "w1 w2", "h9", "p"),
    ]
    labels = [(i, (i // 2) % 2) for i in range(30)] + [(None, 1), (3, None), (4, 1), (4, 0)]
    monkeypatch.setattr(quality, "strength", lambda groups, by: 7.0 if by is None else 3.0)
    kept = {}
    real = quality.calibration
    monkeypatch.setattr(quality, "calibration", lambda known: kept.setdefault("rows", known.collect()) and real(known))
    docs, truth = spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string",
    ), spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(quality.assess(docs, truth, F.col("source"), F.col("lang")).collect(), key=lambda r: (r["doc_id"], r["host_share"]))
    x, shares = brute_quality(rows, labels)
    want = sorted(
        ((r[0], (hg + 7.0 * o) / (hn + 7.0), (pg + 3.0 * (hg + 7.0 * o) / (hn + 7.0)) / (pn + 3.0)) for r, (o, hg, hn, pg, pn) in zip(rows, shares))
    )
    assert [(r["doc_id"], r["host_share"], r["path_share"]) for r in got] == [(i, pytest.approx(h, abs=1e-5), pytest.approx(p, abs=1e-5)) for i, h, p in want]
    told = sorted((r["_id"], r["x"]) for r in kept["rows"])
    assert told == [(i, pytest.approx(v)) for i, v in sorted((r[0], v) for r, v in zip(rows, x) if r[0] in range(30))]
    for r in got:
        logit = r["evidence"] + np.log(r["path_share"] / (1 - r["path_share"]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4) and r["kept"] == (r["score"] >= 0.5)


def test_quality_of_labels_that_are_held_back(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where("doc_id % 5 = 0")
    got = quality.assess(docs, labels.where("doc_id % 5 <> 0"), F.col("source"), F.col("lang")).join(test, "doc_id").toPandas()
    y = got["quality"].to_numpy()

    def auc(score):
        rank = score.rank().to_numpy()
        return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))

    assert len(got) > 500 and auc(got["score"]) >= 0.97 and auc(got["evidence"]) >= 0.97


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(8)
    net = langid.train([bytes(rng.integers(97, 110, 200).astype(np.uint8).tolist()) for _ in range(40)], ["a", "b"] * 20, rounds=1)
    windows = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    want = []
    for w in windows:
        pooled = []
        for width, taps in zip(langid.WIDTHS, net.taps):
            pooled += [max(sum(taps[j][w[i + j]][f] for j in range(width)) for i in range(langid.WINDOW - width + 1)) for f in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.probabilities(windows), want, atol=1e-4)

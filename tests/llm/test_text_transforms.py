"""Fill-in-the-middle, importance resampling and BPE by prefixes against plain programs and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deskgrain.llm import fill_middle, prefix_bpe, resample

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle


def filled(doc_id, text, fim=50, spm=80):
    text, h = text or "", sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = UNIT.findall(text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng, n):
    made = [(i, "".join(rng.choices("ab é\t\n日 <>PSM\U0001f600", k=rng.randint(0, 40)))) for i in range(n)]
    return made + [
        (5000, None), (5001, ""), (5002, "  \n "), (5003, "a <P> b"), (5004, "x " * 200_000), (None, "a b c d"), (None, "a b c d"),
        (5005, "a\x00b c\x1f \x85 \xa0d"), (5006, "one"), (5006, "another text"), (5007, "<P" * 50 + "S>" * 50), (5008, "-" * 300_000),
    ]


@pytest.mark.parametrize("fim, spm, size", [(50, 80, 4 << 20), (100, 30, 64), (100, 100, 1)])
def test_fill_middle_is_the_plain_program(spark, monkeypatch, fim, spm, size):
    rows = odd_texts(random.Random(fim), 1500)
    monkeypatch.setattr(fill_middle, "BYTES", size)
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, `FORM` string, h1 int")
    got = fill_middle.transform(d, fim_percent=fim, spm_percent=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "h1", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = got.collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(
        (i, *filled(i, t, fim, spm)) for i, t in rows
    )
    assert all(r["back"] == (r["text"] or "") and r["h1"] == 7 for r in got)
    assert {r["form"] for r in got} == {"plain", "spm"} | ({"psm"} if spm < 100 else set())


def test_fill_middle_of_nothing(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- importance resampling


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [a + " " + b for a, b in zip(w, w[1:])]


def resampled(rows, target, percent, seed=7):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        n, f = features(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, f))
        w = w // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("percent, block", [(25, 1 << 20), (100, 16), (0, 1), (3, 100)])
def test_resampling_is_the_plain_program(spark, monkeypatch, percent, block):
    rng, words = random.Random(percent), ["The", "cat", "é", "日本", "x1", "a-b", "Q", "MiXed"] + [f"w{i}" for i in range(50)]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(700)]
    rows += [(7000, None), (7001, ""), (None, "a b " * 30), (None, "c d " * 30), (7003, "LongWord" * 9 + " word " * 20_000)]
    rows += [(7002, "rep " * 25)] * 40 + [(7004, "Z" * 5000 + " " + "é" * 400)]
    target = [" ".join(rng.choices(words[:20], k=50)) for _ in range(50)] + [None, ""]
    monkeypatch.setattr(resample, "BLOCK", block)
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(5)
    b = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resample.resample(d, b, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == resampled(rows, target, percent)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_the_cutoff_is_exact(spark, tasks):
    rng = random.Random(tasks)
    for rows in ([(rng.randint(-3, 3), rng.randint(0, 9)) for _ in range(200)], [(5, 5)] * 60, [(1, 2)]):
        keys = spark.createDataFrame(rows, "k1 long, k2 long").repartition(tasks).cache()
        for rank in {1, len(rows) // 3 or 1, len(rows)}:
            assert resample.cutoff(keys, rank) == sorted(rows)[rank - 1]
        assert resample.cutoff(keys, 0) is None and resample.cutoff(keys, len(rows) + 1) is None


def test_resampling_of_and_towards_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    (r,) = resample.resample(some, none, percent=100).collect()
    assert (r["n_words"], r["n_features"], r["rank"]) == (40, 79, 1)


# ---- BPE by prefixes


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.tokenizer(PATH, P.PATTERN)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_prefix_bpe_knows_every_character(library, bpe):
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0):
            t = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 ,{chr(c)}. {chr(c)} "
            assert bpe.encode(t) == ids(library, t), hex(c)


def test_prefix_bpe_of_random_strings(library, bpe):
    rng = random.Random(13)
    for _ in range(4000):
        k = rng.choice(["ab", "etaoin ", "   \n", "éàü", "0123", "xyz", "-=", "aaaa ", "the and ing ", "日本 語", "'s't're"])
        t = "".join(rng.choices(k, k=rng.randint(0, 200)))
        t = t if rng.random() < 0.9 else "<|endoftext|>".join([t[:9], t[9:], ""])
        assert bpe.encode(t) == ids(library, t)
    for t in ("=" * 4001, " " * 3000, "a" * 5000, "ab" * 3333, "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext"):
        assert bpe.encode(t) == ids(library, t)


def test_every_token_stands_or_not_as_the_library_says(library, bpe):
    """No token is taken for its own bytes where merges lead to others."""
    rng = random.Random(1)
    for t in rng.sample(sorted(bpe.made), 4000):
        data = bpe.token[t]
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if len(bpe.find(text)) == 1:
            assert bpe.stands(t) == (ids(library, text) == [t])


def test_prefix_bpe_of_documents(spark, library, sf):
    from deskgrain.llm.queries import op13_prefix_bpe

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_prefix_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = ids(library, docs[r["doc_id"]])
        back = library.decode(want, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(",".join(map(str, want))), sha(back))


def test_prefix_bpe_columns_and_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "Hello <|endoftext|> world"), (3, "日本語 ñandú \U0001f600 " * 300), (4, " " * 3_000 + "x" + "-=" * 700)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    back = prefix_bpe.decode(prefix_bpe.encode(d, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert [(r["ids"], r["decoded"]) for r in back] == [(ids(library, t or ""), t or "") for _, t in rows]
    told = prefix_bpe.round_trip(d, PATH, P.PATTERN, with_ids=True).collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids"]) for r in told] == [(i, len(ids(library, t or "")), ids(library, t or "")) for i, t in rows]
    assert prefix_bpe.round_trip(d.limit(0), PATH, P.PATTERN).count() == 0
    lists = [[50256, 15496], [99999, 15496], [162], None, []]
    got = prefix_bpe.decode(spark.createDataFrame([(x,) for x in lists], "ids array<int>"), PATH, P.PATTERN).collect()
    assert [r["decoded"] for r in got] == [library.decode(x or [], skip_special_tokens=False) for x in lists]


def test_prefix_bpe_refuses_what_it_would_get_wrong(bpe):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    for part, change in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", None)):
        with pytest.raises(ValueError):
            prefix_bpe.PrefixBPE({**spec, part: change}, P.PATTERN)
    with pytest.raises(ValueError):
        prefix_bpe.PrefixBPE({**spec, "model": {**spec["model"], "merges": spec["model"]["merges"][1:]}}, P.PATTERN)

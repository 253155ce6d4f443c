import hashlib
import random
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from deskgrain.llm import bpe, graph, mixing, near_copies

P = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(spark):
    en = [f"the {w} of the house and the {v} were with them in that long evening by the sea number {i}" for i, (w, v) in enumerate([("door", "roof"), ("wall", "cat"), ("lamp", "dog"), ("tree", "boat")] * 6)]
    rows = [(i, t + " " + " ".join(f"{t.split()[1]}{i}x{j}" for j in range(40)), "en", f"s{i % 3}", len(t)) for i, t in enumerate(en)]
    return rows + [
        (90, rows[0][1], "en", "s0", 1), (91, None, None, None, None), (92, "12 34", "de", "s1", 5), (93, "", "fr", None, 0),
        (94, "und der Hund ist nicht im Haus und die Katze auch nicht", "de", None, 3),
        (94, "und der Hund ist nicht im Haus und die Katze auch nicht", "de", None, 3),
    ]


def test_stages_in_order(spark):
    rows = small_corpus(spark)
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {91, 92, 93} & set(ids) and set(range(24)) <= set(ids)
    single = pipeline.near_dedup(spark, kept, "")
    after = sorted(r["doc_id"] for r in single.collect())
    assert single.columns == docs.columns and 90 not in after and after.count(94) == 1 and after.count(0) == 1
    cut = pipeline.passage_dedup(spark, single, "")
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mixed = pipeline.mixing_stage(spark, cut, "")
    assert mixed.columns == docs.columns
    total, taken = (d.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] for d in (cut, mixed))
    assert 1.2 * total < taken < 1.8 * total
    out = pipeline.tokens(spark, mixed, "").collect()
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == mixed.count() and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_writes_each_stage(spark, sf):
    assert pipeline.run(spark, sf).count() > 50


def copies_of(n, changed, seed):
    """A text of n words, and one that differs in `changed` words in a row."""
    words = [f"w{seed}x{i}" for i in range(n)]
    return " ".join(words), " ".join(f"c{i}" if i < changed else w for i, w in enumerate(words))


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_from_a_similarity_of_four_fifths(spark):
    like = [(copies_of(60, 5, i), i) for i in range(30)]  # 51 of 61 shingles: 0.836
    unlike = [(copies_of(60, 7, i), i) for i in range(30, 60)]  # 49 of 63: 0.778
    assert all(jaccard(*p) >= 0.8 for p, _ in like) and all(0.75 < jaccard(*p) < 0.8 for p, _ in unlike)
    rows = [(2 * i + k, t, "en", "s", len(t)) for p, i in like + unlike for k, t in enumerate(p)]
    got = {r["doc_id"] for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert {2 * i + k for _, i in unlike for k in (0, 1)} <= got and all(2 * i in got for _, i in like)
    assert sum(2 * i + 1 in got for _, i in like) <= 1


def test_short_texts_and_a_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(80)]
    group = [" ".join(base[:i % 70] + [f"n{i}"] + base[i % 70 + 1 :]) for i in range(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(group + ["a b", "A  b", "a c", "a b c d e f", "a b c d e g"])]
    got = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    assert got == [0, 300, 302, 303, 304]


def test_groups_of_the_first_search_are_one_node_of_the_second(spark, monkeypatch):
    seen = []

    def components(edges):
        seen.append([tuple(e) for e in edges.select("src", "dst").collect()])
        return graph.connected_components(edges)

    monkeypatch.setattr(near_copies, "connected_components", components)
    monkeypatch.setattr(near_copies, "FEW", 1)
    base = [f"b{i}" for i in range(80)]
    group = [" ".join(base[:i % 70] + [f"n{i}"] + base[i % 70 + 1 :]) for i in range(100)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*group, *copies_of(60, 5, 0), "apart from all others"])]
    got = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    assert got == [0, 100, 102]
    first, second = seen
    assert len(first) > 10
    linked = graph.connected_components(spark.createDataFrame(first, "src long, dst long")).collect()
    inner = {r["node"] for r in linked}  # nodes that are no longer named: their group's smallest stands for them
    assert inner and not inner & {x for e in second for x in e}


def test_mixing_keeps_no_level_in_its_plan(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Join") == 1


def test_null_and_repeated_ids_merge_nothing(spark):
    text = [" ".join(f"t{i}x{j}" for j in range(20)) for i in range(6)]
    rows = [
        (None, text[0], "en", "s", 1), (None, text[1], "en", "s", 2), (None, text[1], "en", "s", 2),
        (None, text[2], "en", "s", 3), (7, text[2], "en", "s", 4), (8, text[3], "en", "s", 5), (8, text[4], "en", "s", 6),
        (9, text[4], None, "s", 7), (8, text[5], "en", "a", 8), (8, text[5], "en", "b", 8),
    ]
    want = [(None, text[0]), (None, text[1]), (7, text[2]), (8, text[3]), (8, text[4]), (8, text[5])]
    got = [pipeline.near_dedup(spark, spark.createDataFrame(r, COLUMNS).repartition(n), "").collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert all(sorted(((r["doc_id"], r["text"]) for r in g), key=lambda r: r[1]) == want for g in got)
    assert set(got[0]) == set(got[1])


CLASHES = "lang_pred lang_score net k1 k2 K1 sid root row first spans t1 t2 mix_source base bound times copy mix_times left".split()


def test_columns_of_any_name_pass_through(spark):
    names = [c for i, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:i]}]
    rows = [(*r, *[f"{c}{r[0]}" for c in names]) for r in small_corpus(spark)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in names))
    for _, stage in pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        got = docs.collect()
        assert docs.columns == [*(c.split(" ")[0] for c in COLUMNS.split(", ")), *names] and len(got) > 10
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)


def sets(text):
    """Shingles of five words of a text; one of fewer words is one shingle."""
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split() if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words)))))


def brute_near_dedup(docs):
    """The first row of each group, by all pairs."""
    shingles, label = [sets(d[1]) for d in docs], list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if (a == b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                label[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return groups.values()


def brute_passages(docs, length=200):
    raw = [d[1].encode() for d in docs]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in zip(docs, raw):
        keep = bytearray(b"\1" * len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                keep[i : i + length] = bytes(length)
        text = bytes(b for b, k in zip(t, keep) if k).decode("utf-8", "ignore")
        if text:
            out.append((d[0], text, *d[2:4], len(text)))
    return out


def brute_mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = lambda t: len((t or "").split())
    total = Counter()
    for d in docs:
        total[d[3]] += size(d[1])
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    w, target, open_, left = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * total[s]}
        for s in over or open_:
            target[s] = cap * total[s] if over else level * w[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    out = []
    for s in names:
        base = min(int(target[s] // total[s]), int(cap)) if total[s] else 0
        budget, by_hash = target[s] - base * total[s], {}
        for d in docs:
            if d[3] == s:
                by_hash.setdefault(int(hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest()[:15], 16), []).append(d)
        run, more = 0, True
        for h in sorted(by_hash):
            n = sum(size(d[1]) for d in by_hash[h])
            take = more and (run + n <= budget or run + n - budget < budget - run)
            more = more and run + n <= budget
            run += n
            out += [d for d in by_hash[h] for _ in range(min(base + take, int(cap)))]
    return out


def test_stages_against_brute_force(spark):
    """Every stage but the first on what its predecessor kept, against plain loops; what the first keeps has a language."""
    rng = random.Random(9)
    words = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly"]) for _ in range(n))
    shared, rows = text(70), []
    for i in range(40):
        t = text(rng.randint(5, 90))
        rows.append((i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)))
        if i % 5 == 0:  # near copies, copies, and passages that texts share
            near = t.split()
            near[rng.randrange(len(near))] = "changed"
            rows += [
                (100 + i, " ".join(near), "en", "s1", 1), (200 + i, t, "en", None, 1),
                (300 + i, f"{text(20)} {shared} {text(15)}", "en", "s2", 1),
            ]
    rows += [
        (None, text(30), "en", "s0", 1), (None, text(30), "en", "s0", 1), (500, None, "en", "s0", 0), (501, "", None, None, 0),
        (502, "1 2 3", "en", "s0", 5), (3, text(25), "en", "s3", 1),
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    kept = rows_of(pipeline.language(spark, docs, ""))
    assert {r[0] for r in kept} >= {r[0] for r in rows if r[1] and len(r[1]) > 60} and not {500, 501, 502} & {r[0] for r in kept}
    frame = lambda held: spark.createDataFrame(held, COLUMNS)
    single = rows_of(pipeline.near_dedup(spark, frame(kept), ""))
    groups = brute_near_dedup(kept)
    assert len(single) == len(groups) < len(kept) - 10
    assert all(sum(d in single for d in g) == 1 and min((d[0] is None, d[0]) for d in g)[1] == next(d[0] for d in g if d in single) for g in groups)
    cut = rows_of(pipeline.passage_dedup(spark, frame(single), ""))
    assert cut == sorted(brute_passages(single), key=repr) and sum(len(d[1]) for d in cut) < sum(len(d[1]) for d in single) - 1_000
    mixed = rows_of(pipeline.mixing_stage(spark, frame(cut), ""))
    assert mixed == sorted(brute_mix(cut), key=repr) and mixed != cut
    tik = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks,
        special_tokens={},
    )
    want = [(d[0], tik.encode_ordinary(d[1]), hashlib.sha256(d[1].encode()).hexdigest()) for d in mixed]
    got = [(r["doc_id"], r["ids"], r["decoded_sha256"]) for r in pipeline.tokens(spark, frame(mixed), "").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sets_are_one_by_128_bits(spark):
    """Sets that share the first digest alone are two nodes; rows of one set stay one."""
    from deskgrain.llm import near_copies

    rows = [(1, 5, 1, 9, 0, 0), (2, 5, 2, 9, 0, 0), (3, 5, 2, 9, 0, 0), (4, 6, 1, 9, 0, 0), (5, 6, 1, 9, 1, 1), (6, 7, 3, 0, 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, sid long, s2 long, n int, a long, b long")
    got = {r["doc_id"]: r["sid"] for r in near_copies.apart(d).collect()}
    assert got[1] != got[2] == got[3] and got[4] == got[5] == 6 and got[6] == 7 and len(set(got.values())) == 4
    assert near_copies.apart(d.where("doc_id > 3")).columns == ["doc_id", "sid", "n", "a", "b"]

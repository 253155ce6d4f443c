import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deskgrain.llm import embedding_dedup, graph, simhash, suffix


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {k: v for k, v in components_of({x for e in edges for x in e}, edges).items() if k != v}
    assert got == want


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_stop_as_soon_as_all_edges_lead_to_roots(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "written", lambda df, what, f=graph.written: made.append(what) or f(df, what))
    stars = [(1, 10 + i) for i in range(20)] + [(2, 40), (41, 2), (2, 40)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert got == {**{10 + i: 1 for i in range(20)}, 40: 2, 41: 2} and made == ["edges"]  # no round for what is done


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", (8, 16))
    monkeypatch.setattr(simhash, "SUB", 4)
    rng = random.Random(2)
    base = " ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=300))
    rows = [(i, base.replace("alpha", "alphA", i) if i % 2 else base + f" extra{i}") for i in range(30)]
    rows += [(100 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (203, "one"), (204, "Ünïcode WORT drei vier fünf")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.components(d).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    want = components_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n:] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert len(got) == len(rows)
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in got)
    assert len({want[i] for i in range(0, 30)}) < 30


def test_simhash_of_nothing(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append(
            (
                len(t), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum()),
                hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest(),
            )
        )
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 4, 1])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, group):
    """Groups of one anchor whole in a bucket, split into halves, and split down to single offsets."""
    monkeypatch.setattr(suffix, "CHUNK", 1_500)
    monkeypatch.setattr(suffix, "BUCKET", 40)
    monkeypatch.setattr(suffix, "CUTOFF", 3)
    rng = random.Random(5)
    word = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    shared, line = word(80), word(34)
    texts = [word(60) for _ in range(6)] + [f"{word(30)} {shared} {word(20)}" for _ in range(5)] + [f"{line}\n{word(40)}\n{line}" for _ in range(6)]
    texts += [shared[:k] + word(10) for k in (199, 200, 201, 260)] + [shared[50:320], "x" * 1_000, "ab" * 300, "\0" * 250 + "é" * 300, word(1_500)]
    texts += [texts[0], texts[0], None, "", "short", "short"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_report(d, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut([(t or "").encode() for t in texts], 200)
    assert sum(v[1] for v in got.values()) > 5_000


def test_multikey_quicksort_sorts(monkeypatch):
    rng = np.random.default_rng(4)
    for cutoff, chars, n in ((2, 2, 300), (50, 3, 2_000), (2_048, 9, 5_000)):
        monkeypatch.setattr(suffix, "CUTOFF", cutoff)
        words, group = rng.integers(0, chars, (n, 5)).astype(np.uint64), rng.integers(0, 4, n)
        for g in (None, group):
            order = suffix.multikey_order(words, g)
            rows = np.concatenate((np.zeros((n, 1), np.int64) if g is None else g[:, None], words.astype(np.int64)), 1)
            assert sorted(order.tolist()) == list(range(n)) and [tuple(r) for r in rows[order]] == sorted(map(tuple, rows))


def test_suffix_dedup_keeps_columns_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame(
        [(1, "head " + long, "a"), (2, long + " tail", "b"), (3, None, "c"), (4, "", None)],
        "doc_id long, text string, T1 string",
    )
    got = {r["doc_id"]: (r["text"], r["T1"]) for r in suffix.dedup(d).collect()}
    assert got == {1: ("head ", "a"), 2: (" tail", "b"), 3: (None, "c"), 4: ("", None)}


def test_suffix_dedup_of_nothing(spark):
    assert suffix.dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_row_is_a_copy(spark):
    t = " ".join(f"q{i}" for i in range(100))
    got = suffix.dedup_report(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [len(t)] * 2


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 12)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base[rng.integers(0, 12, 150)] + rng.normal(scale=0.25, size=(150, 8)), np.repeat(base[:1], 10, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [
        (900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 1), (903, [float("inf")] + [1.0] * 7, 1),
        (904, x[0].tolist(), None), (905, [1.0, 2.0], 0), (906, [None] + [1.0] * 7, 0), (910, [1.0, 2.0], 0),
        (911, [2.0, 1.0], 0), (912, [1.0, 2.0], 1),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(d, threshold=0.93).collect()}
    n = x.astype(np.float64)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    sim = n @ n.T
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if i % 2 == j % 2 and sim[i, j] >= 0.93]
    want, links = components_of(range(len(x)), pairs), Counter(i for p in pairs for i in p)
    assert {i: got[i] for i in range(len(x))} == {i: (links[i], want[i], want[i] == i) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in (*range(900, 905), 906, 911, 912))
    assert got[905] == (1, 905, True) and got[910] == (1, 905, False)  # another length: linked among themselves
    assert pairs


@pytest.mark.parametrize("threshold", [0.6, 0.93])
def test_visits_lose_no_pair(threshold):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embedding_dedup.kmeans(x, 24, spherical=True)
    home, row, cell = embedding_dedup.visits(x, centres, threshold)
    stands = {(i, c) for i, c in enumerate(home)} | set(zip(row.tolist(), cell.tolist()))
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    assert len(a) and all((i, min(home[i], home[j])) in stands and (j, min(home[i], home[j])) in stands for i, j in zip(a, b))
    assert len(row) < len(x) * 12  # far fewer than all cells
    few = embedding_dedup.fitted(x, 24, threshold)
    assert len(few) == 1 or 1 + len(embedding_dedup.visits(x, few, threshold)[1]) / len(x) <= embedding_dedup.STANDS


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

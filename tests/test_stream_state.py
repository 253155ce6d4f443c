import datetime as dt
import math
import random
import statistics

from deskgrain.streaming import jobs as J
from deskgrain.streaming.ledger import CLEANUP, Ledger

FACT = "created_at timestamp, user_id long, confidence string, action string, edit_ratio double, latency_ms double, cost_usd double, error boolean"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def made(seed, n):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [
        (
            at(r.choice([1, 2, 4, 12]), r.randrange(24)), pick(None, 5, 70_000, r.randrange(40)), pick(None, " ", "HIGH", "LOW"), pick(None, "", "edited", "sent_as_is"),
            pick(None, r.random()), pick(None, *[r.random() * 100] * 9), pick(None, r.random()), pick(None, True, False),
        )
        for _ in range(n)
    ]


def named(x, other):
    return x.strip() or other if x else other


def test_day_and_week_figures_of_batches_in_any_order(spark, tmp_path):
    facts = made(1, 3000)
    job = lambda: J.DayFigures(spark, f"file://{tmp_path}/days", buckets=3)
    assert job().days() is None and job().rolling() is None
    batches = [facts[:1400], [], facts[1400:1401], facts[1401:] + [(None, *facts[0][1:])]]
    for i, rows in enumerate(batches):
        job()(spark.createDataFrame(rows, FACT), i)
    job()(spark.createDataFrame(batches[0], FACT), 0)  # a batch that runs again
    got = {r["metric_date"].day: r for r in job().days().collect()}
    assert set(got) == {1, 2, 4, 12}
    for day, r in got.items():
        held = [f for f in facts if f[0].day == day]
        actions = [named(f[3], "pending") for f in held]
        assert (r["total"], r["edited"], r["sent_as_is"], r["pending"], r["rejected"]) == (len(held), *[actions.count(a) for a in ("edited", "sent_as_is", "pending")], 0)
        assert r["active_users"] == len({f[1] for f in held} - {None})
        assert r["covered"] == sum(f[2] == "HIGH" for f in held) and r["reject_rate"] == 0.0
        assert math.isclose(r["mean_edit_distance"], statistics.mean(f[4] for f in held if f[4] is not None), abs_tol=1e-4)
        assert math.isclose(r["avg_cost_usd"], statistics.mean(f[6] for f in held if f[6] is not None), abs_tol=1e-6)
        pairs = [f"{named(f[2], 'unknown')}/{a}" for f, a in zip(held, actions)]
        assert r["breakdown"] == {p: pairs.count(p) for p in pairs}
        values = sorted(f[5] for f in held if f[5] is not None)
        for p, x in ((0.5, r["latency_p50_ms"]), (0.95, r["latency_p95_ms"])):
            assert abs(sum(v <= x for v in values) / len(values) - p) < 0.02 and x in values
    weeks = {r["metric_date"].day: r for r in job().rolling(7).collect()}
    assert set(weeks) == set(range(1, 11)) | {12}  # no fact of the seven days up to the 11th
    for day, r in weeks.items():
        held = [f for f in facts if day - 6 <= f[0].day <= day]
        assert (r["total"], r["errors"], r["active_users"]) == (len(held), sum(bool(f[7]) for f in held), len({f[1] for f in held} - {None}))
        assert math.isclose(r["total_cost_usd"], sum(f[6] or 0 for f in held), abs_tol=1e-4)


def test_figures_of_facts_of_nulls(spark, tmp_path):
    job = J.DayFigures(spark, f"file://{tmp_path}/days", buckets=2)
    job(spark.createDataFrame([(at(3), *[None] * 7)], FACT), 0)
    day, week = job.days().first(), job.rolling().first()
    assert (day["total"], day["pending"], day["latency_p50_ms"], day["active_users"], day["avg_cost_usd"]) == (1, 1, None, 0, 0.0)
    assert (week["total"], week["avg_latency_ms"], week["latency_p95_ms"], week["total_cost_usd"], week["active_users"]) == (1, None, None, 0.0, 0)


def test_retention_drops_days_and_cuts_the_first(spark, tmp_path):
    folder = f"file://{tmp_path}/facts"
    job = lambda: J.RetainedFacts(spark, folder, days=3)
    batch = lambda *rows: spark.createDataFrame(list(rows), "id int, ts timestamp")
    assert job().read() is None
    seen = []
    for i, rows in enumerate(
        [
            [(1, at(1, 5)), (2, at(2, 5)), (3, None)], [(4, at(4, 5)), (5, at(1, 4))], [(6, at(5, 6))], [(7, at(2, 7)), (8, at(2, 3)), (9, at(1))], [(10, at(9))], [],
        ]
    ):
        seen += rows
        for _ in range(2):  # each batch runs twice
            job()(batch(*rows), i)
        held = [(n, t) for n, t in seen if t]
        newest = max(t for _, t in held)
        # facts that were dropped once do not come again, as the newest time only grows
        assert sorted(r["id"] for r in job().read().collect()) == sorted(n for n, t in held if t >= newest - dt.timedelta(days=3))
    assert [p.name for p in tmp_path.glob("facts/data/*/day=2024-01-09")] == ["day=2024-01-09"]
    assert set(job().ledger.last()["live"]) == {"day=2024-01-09"}


def test_a_batch_that_breaks_leaves_no_half_state_and_old_versions_go(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/state", "k int, o int, v string"
    state = lambda: J.LatestState(spark, "k", "o", folder, buckets=2)
    rows = lambda x: spark.createDataFrame([(k, x, f"{k}-{x}") for k in range(6)], schema)
    state()(rows(1), 0)

    class Broken(Ledger):
        def commit(self, *a, **k):
            raise OSError("killed")

    job = state()
    job.state.ledger = Broken(spark, folder)
    try:
        job(rows(2), 1)
    except OSError:
        pass
    assert {r["o"] for r in state().read().collect()} == {1}
    state()(rows(2), 1)
    assert {(r["k"], r["o"]) for r in state().read().collect()} == {(k, 2) for k in range(6)}
    for i in range(2, 8):
        state()(rows(i + 1), i)
    state()(rows(99), 3)  # committed long ago
    assert {r["o"] for r in state().read().collect()} == {8} and state().read().count() == 6
    assert len(list(tmp_path.glob("state/manifests/*.json"))) == 3
    held = {p for p in tmp_path.glob("state/data/*/bucket=*")}
    assert {int(p.parent.name.split("=")[1].split("-")[0]) for p in held} == {5, 6, 7}  # those of the last three manifests, and nothing broken


def test_buckets_are_merged_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """What a merge holds besides the table does not grow with it: new rows and shuffle files go with each group of buckets."""
    monkeypatch.setattr(J, "MERGE_BYTES", 1)
    state, seen = J.Buckets(spark, f"file://{tmp_path}/state", "k", 4), []

    def how(old, new):
        left = [p for p in tmp_path.glob("state/data/batch=1-*/bucket=*")]
        seen.append((sorted(r["k"] for r in new.collect()), sorted(r["k"] for r in old.collect()), len(left), spark.conf.get(CLEANUP)))
        return old.unionByName(new)

    rows = spark.range(40).withColumnRenamed("id", "k")
    state.merge(rows, 0, lambda old, new: new)
    state.merge(rows, 1, how, lambda new: new.where("k < 1000"))
    assert sorted(k for new, _, _, _ in seen for k in new) == list(range(40)) and len(seen) == 4
    assert all(new == old for new, old, _, _ in seen) and all(on == "true" for *_, on in seen) and spark.conf.get(CLEANUP) == "false"
    assert [left for _, _, left, _ in seen] == [3, 3, 3, 3]  # of the arrived and the merged buckets together
    assert sorted(r["k"] for r in state.read().collect()) == sorted(2 * list(range(40)))
    assert len(list(tmp_path.glob("state/data/batch=1-*/bucket=*"))) == 4


def test_a_second_writer_is_refused(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/t")
    live, schema = ledger.write(spark.createDataFrame([(1, 2)], "k int, v int"), "k", 0)
    before = ledger.last()
    ledger.commit(before, live, schema, 0)
    try:
        ledger.commit(before, {}, schema, 0)
        raise AssertionError("taken")
    except RuntimeError:
        pass
    assert [tuple(r) for r in ledger.read().collect()] == [(2,)]

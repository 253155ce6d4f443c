import random
import re

import pytest
from pyspark.sql import functions as F

from deskgrain.functions import text as T


def column(spark, values, f):
    return [
        r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()
    ]


def test_redaction_order_and_marks(spark):
    got = column(
        spark,
        [
            "write to a.b@x.org or 555-123-4567", "token_abcdefghijklmn123 here", "card 4111 1111 1111 1111 ok",
            "acct id: ZX12345", None, "hello Jane Roe, hi",
        ],
        lambda c: T.redact(c, ("ACCOUNT_ID", "PERSON")),
    )
    assert got[0] == "write to [redacted_email] or [redacted_phone]"
    assert got[1] == "[redacted_secret] here"
    assert "1111" not in got[2] and "[redacted_" in got[2]
    assert got[3] == "acct id: [redacted_account_id]"
    assert got[4] == ""
    assert got[5] == "hello [redacted_name], hi"


def test_redaction_agrees_with_python_patterns(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.redact(F.col("text")).alias("r")).limit(60).collect()
    for row in rows:
        t = row["text"]
        for p, by in (
            (T.EMAIL, "[redacted_email]"), (T.PHONE, "[redacted_phone]"), (T.SECRET, "[redacted_secret]"),
            (T.PAYMENT, "[redacted_payment_identifier]"),
        ):
            t = re.sub(p, by, t)
        assert t == row["r"]


def test_redaction_can_be_cut(spark):
    assert column(spark, ["abcdef"], lambda c: T.redact(c, max_len=3)) == ["abc"]


def test_slug_and_facts(spark):
    assert column(spark, ["Hello, World!", "--a b--"], T.slug) == ["hello__world", "a_b"]
    assert column(
        spark, ["Short. This sentence is long enough to be one. More.", "tiny"], T.first_fact,
    ) == ["This sentence is long enough to be one.", "tiny"]


@pytest.mark.parametrize(
    "value,strict,loose",
    [("true", True, True), ("YES", True, True), ("0", False, False), ("approved", None, True), ("maybe", None, False), (None, None, False)],
)
def test_booleans(spark, value, strict, loose):
    assert column(spark, [value], T.strict_bool) == [strict]
    assert column(spark, [value], T.truthy) == [loose]


def test_stale_needs_a_date_in_the_past(spark):
    d = spark.createDataFrame(
        [("2024-01-01", ""), ("", "2024-03-01T00:00:00Z"), ("not a date", ""), ("", ""), (None, "2024-01-31")],
        "e string, r string",
    )
    got = [x[0] for x in d.select(T.stale(F.col("e"), F.col("r"), F.lit("2024-02-01").cast("timestamp"))).collect()]
    assert got == [True, False, False, False, True]


def slow_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_token_edit_distance(spark):
    rng = random.Random(4)
    pairs = [(" ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for _ in range(40)] + [
        (None, "a b"), ("", ""), ("a b c", None),
    ]
    got = [
        r[0] for r in spark.createDataFrame(
            [(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string",
        ).coalesce(1).select(T.token_edit_distance(F.col("a"), F.col("b"))).collect()
    ]
    assert got == [slow_distance((a or "").split(), (b or "").split()) for a, b in pairs]


def test_token_edit_distance_of_long_lists(spark):
    rng, pairs = random.Random(5), []
    for n in (1, 62, 63, 64, 65, 128, 129, 500):
        for names in ("ab", [f"w{i}" for i in range(150)]):
            a = rng.choices(names, k=n)
            pairs.append((" ".join(a), " ".join(rng.choices(names, k=rng.randint(0, n)))))
            pairs.append((" ".join(a), " ".join(x for x in a if rng.random() < 0.9)))
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = dict(map(tuple, d.select("i", T.token_edit_distance(F.col("a"), F.col("b"))).collect()))
    assert [got[i] for i in range(len(pairs))] == [slow_distance(a.split(), b.split()) for a, b in pairs]

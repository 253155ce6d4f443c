"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.functions import text as T

AS_OF = "2024-02-01 00:00:00"
#: White space as DuckDB must be told it.
WS = r"'[ \t\n\r\f\v]+'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {WS}), lambda x: x <> '')"


def redact_sql(c: str, entities: tuple[str, ...] = ()) -> str:
    """``text.redact`` for DuckDB, whose patterns cannot look around themselves: the neighbours of a phone number are captured
    and put back, twice, as neighbours may share one; a word boundary stands for the end of a name."""
    t = f"regexp_replace(coalesce({c}, ''), {quoted(T.EMAIL)}, '[redacted_email]', 'g')"
    phone = "(^|[^0-9])" + T.PHONE.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)") + "([^0-9]|$)"
    for _ in range(2):
        t = f"regexp_replace({t}, {quoted(phone)}, '\\1[redacted_phone]\\2', 'g')"
    for pattern, mark in ((T.SECRET, "[redacted_secret]"), (T.PAYMENT, "[redacted_payment_identifier]")):
        t = f"regexp_replace({t}, {quoted(pattern)}, '{mark}', 'g')"
    name = T.NAME.removesuffix(r"(?=\b|[,.;:])") + r"\b"
    for entity, pattern, mark in (
        ("ACCOUNT_ID", T.ACCOUNT_ID, "\\1[redacted_account_id]"), ("ADDRESS", T.ADDRESS, "[redacted_address]"),
        ("PERSON", name, "\\1[redacted_name]"),
    ):
        if entity in entities:
            t = f"regexp_replace({t}, {quoted(pattern)}, '{mark}', 'g')"
    return t


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {WS}, ' ', 'g'))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(names: list[str], n: Column) -> Column:
    """The n-th of ``names``, from 0."""
    return F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))


def book():
    """(queries, sql, decorator) of a module of queries."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return queries, sql, query

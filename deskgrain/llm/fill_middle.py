"""Fill-in-the-middle transformation of texts, whole batches at a time.

A batch is a pipeline of pyarrow.compute steps: texts are split into lists of units, the lists flattened with the index of
their text, units numbered within it, filtered by their role (prefix, middle, suffix), each role's units made lists again, and
the lists joined into pieces and the pieces into outputs. The units of a text come from its bytes: a mark goes in wherever
white space follows other characters. The mark is the byte FF, which no UTF-8 text has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The three marks of an output, before its prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
MARK = b"\xff"
#: Bytes of text that one run of the pipeline takes, except that it takes one text at least.
BYTES = 4 << 20


def draws(id_col: str = "doc_id", seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on the seed and the id alone (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _split(texts: pa.Array) -> pa.ListArray:
    """The units of each text (large binary) as a list; an empty text has none."""
    marked = pc.replace_substring_regex(texts, r"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\\1" + MARK + b"\\2")
    units = pc.split_pattern(marked, MARK)
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar([], units.type), units)


def _pieces(units: pa.ListArray, sizes: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text as text: its units before ``first``, before ``second``, and the others."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts = pc.subtract(pc.cumulative_sum(sizes), sizes)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parent))
    past_first, past_second = (pc.greater_equal(ordinal, cut.take(parent)) for cut in (first, second))
    roles = pc.invert(past_first), pc.and_(past_first, pc.invert(past_second)), past_second
    counts = first, pc.subtract(second, first), pc.subtract(sizes, second)
    made = []
    for role, count in zip(roles, counts):
        ends = pc.cumulative_sum(count)
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
        lists = pa.LargeListArray.from_arrays(offsets, flat.filter(role))
        made.append(pc.cast(pc.binary_join(lists, pa.scalar(b"", flat.type)), pa.large_string()))
    return made


def _transform(texts: pa.Array, h: list[pa.Array], fim: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    units = _split(pc.cast(texts, pa.large_binary()))
    n = pc.cast(pc.list_value_length(units), pa.int64())
    cuts = [_modulo(x, pc.add(n, 1)) for x in h[:2]]
    prefix, middle, suffix = _pieces(units, n, pc.min_element_wise(*cuts), pc.max_element_wise(*cuts))
    plain = pc.or_(
        pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, MARKS)), pc.greater_equal(_modulo(h[2], 100), fim)
    )
    first_suffix = pc.less(_modulo(h[3], 100), spm)
    form = pc.if_else(plain, "plain", pc.if_else(first_suffix, "spm", "psm"))
    glued = [
        pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*parts, "")])
        for parts in ((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    ]
    output = pc.if_else(plain, texts, pc.if_else(first_suffix, *glued))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, output]


def _slices(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in slices of BYTES or less, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        if held and held + size > BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows:
        yield batch.slice(start)


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
    out: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"),
) -> DataFrame:
    """``docs`` with the number of units of each whole text, the form of its output (plain, psm or spm), the characters of its
    prefix and middle (null if plain) and the output, in columns ``out`` (replaced if they are there).

    A unit is a run of other characters with the white space (ASCII space, 9-13) before it, or white space at the end. Where
    the two cuts lie, whether a text stays plain and whether its suffix comes first depends on seed and id alone, so equal
    ids are cut alike and reruns agree. A null text is an empty one, which stays plain, as does a text that holds one of the
    marks; a null id counts as an empty one. Texts may be of any length, rows may repeat, other columns pass whatever their
    names, and an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c.lower() not in {o.lower() for o in out}]
    held = unused([*docs.columns, *out], "text", "h1", "h2", "h3", "h4")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(held[0])
    given = docs.select(*[F.col(f"`{c}`") for c in rest], text, *[h.alias(c) for h, c in zip(draws(id_col, seed), held[1:])])
    kinds = "long", "string", "long", "long", "string"
    k = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, pc.binary_length(whole.column(k))):
                texts = pc.cast(b.column(k), pa.large_string())
                n, form, prefix, middle, output = _transform(texts, b.columns[k + 1 :], fim_percent, spm_percent)
                made = [n, pc.cast(form, pa.string()), prefix, middle, output]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *made], names=[*rest, *out])

    # the schema as a type: names and types of other columns may be such as no DDL text can hold
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c, kind in zip(out, kinds):
        schema = schema.add(c, kind)
    return given.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    piece = F.split(output, MARKS, -1)
    return (
        F.when(form == "spm", F.concat(piece[2], piece[3], piece[1])).when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
        .otherwise(output)
    )

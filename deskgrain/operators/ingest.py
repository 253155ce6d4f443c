"""Ingest transforms: articles to sections, chunks, metadata and re-ingest plans, one DataFrame job for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions import dims
from deskgrain.functions import text as T
from deskgrain.functions.frames import small


def parse_title(raw: Column) -> Column:
    """``Product | Title`` as (product, title, platform); without a bar there is no product."""
    t = F.trim(F.when(raw.contains("|"), F.regexp_extract(raw, r"(?s)^[^|]*\|(.*)$", 1)).otherwise(raw))
    return F.struct(
        F.when(raw.contains("|"), F.trim(F.substring_index(raw, "|", 1))).otherwise("").alias("product"), t.alias("title"),
        F.when(raw.contains("|") & t.rlike(r"(?i)\b(app|mobile)\b"), "app").otherwise("website").alias("platform"),
    )


def parse_release_title(raw: Column) -> Column:
    """``Product | Label | Date`` as (product, title, platform)."""
    p = F.transform(F.split(raw, r"\|"), lambda x: F.trim(x))
    many = F.size(p) >= 2
    return F.struct(
        F.when(many, F.get(p, F.lit(0))).otherwise("").alias("product"),
        F.when(many, F.get(p, F.lit(1))).otherwise(F.trim(raw)).alias("title"),
        F.when(many & F.get(p, F.lit(1)).rlike(r"(?i)\bmobile\b"), "app").otherwise("website").alias("platform"),
    )


def platform(inferred: Column, *fields: Column) -> Column:
    """First field that is neither blank nor ``nan``, in lower case, else what was inferred."""
    tidy = [F.lower(F.trim(f)) for f in fields]
    return F.coalesce(*[F.when(~t.isin("", "nan"), t) for t in tidy], inferred)


def canonical(df: DataFrame, col: str, aliases: DataFrame, default: str, out: str) -> DataFrame:
    """``col`` by an alias table (alias, canonical): ``default`` where blank, unchanged where unknown; of an alias listed twice
    the least name counts."""
    a = small(aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("canonical").alias("_canonical")))
    key = F.lower(F.trim(F.col(col)))
    return df.join(a, key == F.col("_alias"), "left").withColumn(
        out, F.when(F.coalesce(key, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce("_canonical", F.trim(F.col(col)))),
    ).drop("_alias", "_canonical")


def is_table(p: Column) -> Column:
    """Whether a paragraph is a pipe table: two lines with a bar, one of them a separator."""
    lines = F.filter(F.split(p, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 2) & (F.size(F.filter(lines, lambda x: x.contains("|"))) >= 2) & F.exists(lines, lambda x: x.rlike(r"^\s*\|[\s\-:]+\|"))


def heading(p: Column) -> Column:
    """The heading that a paragraph is (``#`` to ``####``, or underlined by ``===`` or ``---``), else null."""
    lines = F.split(p, "\n")
    first, second = F.trim(F.get(lines, F.lit(0))), F.trim(F.get(lines, F.lit(1)))
    return F.when(
        first.rlike(r"^#{1,4}\s+.+"), F.regexp_extract(first, r"^#{1,4}\s+(.+)", 1),
    ).when(second.rlike(r"^={3,}$"), first).when(second.rlike(r"^-{3,}$") & ~first.contains("|"), first)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\n{2,}"), lambda x: F.trim(x)), lambda p: p != "")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(article_id, section_no, section_id, heading, section_text): a heading opens a section; numbered by a running sum."""
    p = docs.select(
        F.col(id_col).alias("article_id"), F.posexplode(paragraphs(F.col(text_col))).alias("pos", "p"),
    ).withColumn("h", heading(F.col("p")))
    w = Window.partitionBy("article_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("section_no", F.sum(F.col("h").isNotNull().cast("int")).over(w))
    g = p.groupBy("article_id", "section_no").agg(
        F.max("h").alias("heading"),
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("h", "p").alias("t")))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n")
    name = F.when(
        F.col("heading").isNull(), "root",
    ).otherwise(F.when(T.slug(F.col("heading")) != "", T.slug(F.col("heading"))).otherwise(F.col("section_no").cast("string")))
    return g.select(
        "article_id", "section_no", F.concat_ws("_", F.lit("sec"), F.col("article_id").cast("string"), name).alias("section_id"),
        F.coalesce("heading", F.lit("")).alias("heading"), text.alias("section_text"),
    )


def pack(items: Column, limit: int, glue: str) -> Column:
    """Items packed greedily, in order, into texts of at most ``limit`` words (a longer item stands alone)."""
    sized = F.transform(items, lambda s: F.struct(s.alias("t"), T.word_count(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["n"] + x["n"] > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), x["t"]).otherwise(F.concat_ws(glue, acc["open"], x["t"])).alias("open"),
            F.when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"),
        )

    return F.aggregate(sized, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def sentence_chunks(c: Column, limit: int = 200) -> Column:
    """A text split at sentence ends into pieces of at most ``limit`` words."""
    return pack(T.sentences(c), limit, " ")


def smart_chunks(secs: DataFrame, limit: int = 200) -> DataFrame:
    """Chunks (article_id, section_id, heading, chunk_no, content) of sections: tables stand alone, paragraphs are packed,
    over-long ones split at sentence ends, and the section's heading leads each chunk. One fold within each section."""
    lead = F.when(F.col("heading") != "", F.concat(F.col("heading"), F.lit("\n\n"))).otherwise("")
    room = F.lit(limit) - T.word_count(F.col("heading"))
    p = F.filter(paragraphs(F.col("section_text")), lambda x: x != F.col("heading"))
    # pieces: (text, words, stands alone)
    pieces = F.flatten(
        F.transform(
            p,
            lambda x: F.when(is_table(x), F.array(F.struct(x.alias("t"), F.lit(0).alias("n"), F.lit(True).alias("alone")))).when(
                T.word_count(x) > limit,
                F.transform(sentence_chunks(x, limit), lambda s: F.struct(s.alias("t"), F.lit(0).alias("n"), F.lit(True).alias("alone"))),
            ).otherwise(F.array(F.struct(x.alias("t"), T.word_count(x).alias("n"), F.lit(False).alias("alone")))),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        closed = F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        full = acc["open"].isNotNull() & (acc["n"] + x["n"] > F.col("_room"))
        return F.struct(
            F.when(x["alone"], F.concat(closed, F.array(x["t"]))).when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(
                x["alone"], F.lit(None).cast("string"),
            ).when(full | acc["open"].isNull(), x["t"]).otherwise(F.concat_ws("\n\n", acc["open"], x["t"])).alias("open"),
            F.when(x["alone"], F.lit(0)).when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"),
        )

    packed = F.aggregate("_pieces", start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    rows = secs.withColumn("_room", room).withColumn("_pieces", pieces).withColumn("_lead", lead)
    chunks = F.when(
        F.size("_pieces") > 0, F.transform(packed, lambda t: F.concat(F.col("_lead"), t)),
    ).otherwise(F.filter(F.array("heading"), lambda h: h != ""))
    return rows.select("article_id", "section_id", "heading", F.posexplode(chunks).alias("chunk_no", "content"))


def keywords(chunks: DataFrame, id_col: str, text_col: str, most: int = 8) -> DataFrame:
    """(id, keywords): the commonest words of three or more ASCII letters that are no stop words; ties by first mention."""
    w = F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
        lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*dims.STOP_WORDS),
    )
    one = chunks.select(F.col(id_col), F.posexplode(w).alias("pos", "word")).groupBy(id_col, "word").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"),
    )
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))).where(F.col("r") <= most)
    return ranked.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ", ").alias("keywords")
    )


def summary(c: Column) -> Column:
    return F.array_join(F.filter(F.slice(T.sentences(F.trim(c)), 1, 2), lambda s: s != ""), " ")


def chunk_type(content: Column, title: Column, head: Column, doc_type: Column, rules: dict[str, dict] = dims.CHUNK_TYPE_RULES) -> Column:
    """Type of the matching rule of highest priority (of equal ones the last by name); tables first, release changes and
    concepts by default. A rule that is not enabled, or of whose negative keywords the content holds one, does not match."""
    c, t = F.lower(F.coalesce(content, F.lit(""))), F.concat_ws("\n", F.lower(head), F.lower(title))
    out = F.when(is_table(content), "table")
    live = {n: r for n, r in rules.items() if r.get("enabled", True)}
    for name, r in sorted(live.items(), key=lambda x: (x[1].get("priority", 0), x[0]), reverse=True):
        hit = T.contains_any(t, r.get("heading", [])) | T.contains_any(c, r.get("content", []))
        out = out.when(hit & ~T.contains_any(c, r.get("negative", [])), name)
    return out.when(doc_type == "release_note", "release_change").otherwise("concept")


def condition_flags(content: Column, title: Column, head: Column) -> Column:
    """Sorted names of the kinds of conditions that a chunk mentions."""
    t = F.lower(F.concat_ws(" ", head, title, content))
    hits = [F.when(T.contains_any(t, words) | (t.rlike(dims.DATE_MENTION) if name == "version_or_date_specific" else F.lit(False)), name) for name, words in dims.CONDITION_FLAGS.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def chunk_texts(
    content: Column, title: Column, head: Column, source_type: Column, product: Column, plat: Column, section_text: Column,
    short: int = 60, near: int = 1_200,
) -> Column:
    """(embedding_text, display_text): labelled context and the chunk; a short chunk also gets the start of its section."""
    def line(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    context = F.concat_ws(
        "\n", line("Title", title), line("Section", head), line("Product", product), line("Platform", plat),
        line("Source type", source_type),
    )
    shown = F.concat_ws("\n", line("Article", title), line("Section", head))
    nearby = F.when(
        (T.word_count(content) < short) & (F.coalesce(section_text, F.lit("")) != ""),
        F.concat(F.lit("Nearby section context: "), F.substring(section_text, 1, near)),
    )
    some = lambda c: F.when(c != "", c)
    return F.struct(
        F.concat_ws("\n\n", some(context), some(content), nearby).alias("embedding_text"),
        F.concat_ws("\n\n", some(shown), some(content)).alias("display_text"),
    )


def incoming(chunks: DataFrame, text: Column) -> DataFrame:
    """Chunks (article_id, chunk_index) of new documents, each with its document's ``text``, as rows for a re-ingest plan."""
    name = F.concat_ws(":", F.col("article_id").cast("string"), "chunk_index")
    return chunks.groupBy("article_id").agg(F.max(T.sha256(text)).alias("document_hash"), F.collect_set(name).alias("chunk_ids"))


def reingest_plan(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming document the action (insert, skip_unchanged, upsert_changed), chunks to upsert and delete, and next version.

    ``existing``: chunks (article_id, chunk_id, document_hash, document_version, is_active); ``incoming``: (article_id,
    document_hash, chunk_ids). Chunks belong to an article by its id, not by a prefix of theirs.
    """
    old = existing.groupBy("article_id").agg(
        F.max(F.when(F.col("is_active"), F.col("document_hash"))).alias("old_hash"),
        F.max("document_version").alias("old_version"), F.collect_set("chunk_id").alias("old_chunks"),
    )
    j = incoming.join(old, "article_id", "left").withColumn("old_chunks", F.coalesce("old_chunks", F.array().cast("array<string>")))
    known = F.coalesce(F.col("old_hash"), F.lit("")) != ""
    action = F.when(~known, "insert").when(
        (F.col("old_hash") == F.col("document_hash")) & (F.size(F.array_except("chunk_ids", "old_chunks")) == 0),
        "skip_unchanged",
    ).otherwise("upsert_changed")
    j = j.withColumn("action", action)
    version = F.coalesce("old_version", F.lit(1)) + (known & (F.col("old_hash") != F.col("document_hash"))).cast("int")
    return j.select(
        "article_id", "action",
        F.when(
            F.col("action") == "skip_unchanged", F.array().cast("array<string>"),
        ).otherwise(F.array_sort(F.array_distinct("chunk_ids"))).alias("chunks_to_upsert"),
        F.array_sort(F.array_except("old_chunks", "chunk_ids")).alias("chunks_to_delete"),
        version.cast("int").alias("next_version"),
    )


def tombstone(chunks: DataFrame, plan: DataFrame, as_of: Column, reason: str = "document_reingested") -> DataFrame:
    """Active chunks of changed documents become inactive, with the reason and the ids that replace them."""
    p = plan.where("action = 'upsert_changed'").select(F.col("article_id").alias("_a"), F.array_join("chunks_to_upsert", ",").alias("_by"))
    hit = F.col("_a").isNotNull() & F.coalesce("is_active", F.lit(True))
    j = chunks.join(p, chunks["article_id"] == p["_a"], "left")
    return j.select(
        *[c for c in chunks.columns if c != "is_active"], (F.coalesce("is_active", F.lit(True)) & ~hit).alias("is_active"),
        F.when(hit, as_of).alias("superseded_at"), F.when(hit, reason).alias("superseded_reason"),
        F.when(hit, F.col("_by")).alias("superseded_by"),
    )


def manifest_errors(rows: DataFrame, row_col: str = "row_number") -> DataFrame:
    """``rows`` with ``errors``, an array of (field, message) that holds every defect; accepted rows have none. The messages are
    fixed values."""
    t = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in dims.MANIFEST_COLUMNS}
    def bad(cond: Column, field: str, message: Column) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), message.alias("message")))
    found = [bad(t[c] == "", c, F.lit("Required field is missing")) for c in dims.MANIFEST_COLUMNS]
    for c, allowed in (
        ("source_type", dims.SOURCE_TYPES), ("source_authority", dims.SOURCE_AUTHORITIES), ("doc_type", dims.DOC_TYPES),
        ("escalation_risk", dims.ESCALATION_RISKS),
    ):
        found.append(bad((t[c] != "") & ~t[c].isin(*allowed), c, F.concat(F.lit("Invalid value: "), t[c])))
    for c in ("is_approved", "is_active", "is_customer_facing_allowed"):
        found.append(bad(T.strict_bool(t[c]).isNull(), c, F.lit("Boolean must be explicit true/false")))
    for c in ("approved_at", "needs_review_at"):
        found.append(bad((t[c] != "") & F.try_to_timestamp(t[c]).isNull(), c, F.lit("Invalid datetime")))
    found.append(
        bad(
            F.coalesce(T.strict_bool(t["is_approved"]), F.lit(False)) & ((t["approved_at"] == "") | (t["reviewed_by"] == "")),
            "approved_at/reviewed_by", F.lit("Approved sources require approved_at and reviewed_by"),
        )
    )
    return rows.withColumn("errors", F.array_compact(F.array(*found)))


def missing_columns(columns: list[str], required: dict[str, list[str]], recommended: list[str]) -> tuple[list[str], list[str]]:
    """Contract of one source: groups none of whose columns is there, and recommended columns that are not (many sources at
    once: ``workbench.source_contract``)."""
    return [g for g, any_of in required.items() if not set(any_of) & set(columns)], [c for c in recommended if c not in columns]


def clean_tickets(tickets: DataFrame, text_col: str) -> DataFrame:
    """Redacted, collapsed ticket text with its counts and hash; reject says why a ticket is not usable, else null."""
    raw = F.col(text_col)
    cleaned = T.collapse(F.replace(T.redact(F.trim(F.coalesce(raw, F.lit("")))), F.lit("\0"), F.lit("")))
    d = tickets.withColumn("cleaned", cleaned)
    return d.withColumns({"normalized": F.lower("cleaned"), "raw_text_hash": T.sha256(F.trim(raw)), "char_count": F.length("cleaned"), "word_count": T.word_count(F.col("cleaned")), "redaction_applied": F.coalesce(raw, F.lit("")) != F.col("cleaned")}).withColumn(
        "reject", F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(F.col("word_count") < 3, "too short"),
    )


def embed(chunks: DataFrame, text_col: str, dims_: int = 384, embed_fn=None, out: str = "embedding") -> DataFrame:
    """Vectors of texts: by a user's ``embed_fn`` (list of texts to array) in batches, else hashed term frequencies of unit length."""
    if embed_fn is not None:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, FloatType

        return chunks.withColumn(out, predict_batch_udf(lambda: embed_fn, return_type=ArrayType(FloatType()), batch_size=64)(F.col(text_col)))
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    d = HashingTF(numFeatures=dims_, inputCol="_tokens", outputCol="_tf").transform(chunks.withColumn("_tokens", T.words(F.lower(F.col(text_col)))))
    return Normalizer(inputCol="_tf", outputCol="_unit").transform(d).withColumn(
        out, vector_to_array("_unit", "float32"),
    ).drop("_tokens", "_tf", "_unit")


# Tier of each source type.
TIERS = {
    "policy": "canonical_policy", "official_help_article": "approved_kb", "knowledge_base": "approved_kb", "faq": "approved_kb",
    "release_note": "approved_release_note", "known_issue": "approved_conditional",
}


def source_metadata(
    category: Column, source_type: Column, article_id: Column, url: Column, file_name: Column, content: Column, as_of: Column,
) -> Column:
    """What a chunk carries of its source: tier, references, approval, audience and hashes. Ticket history and raw types are
    never approved nor shown to customers."""
    raw = (category == "historical_tickets") | source_type.startswith("raw_")
    tier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), source_type), F.lit("unreviewed"))
    return F.struct(
        F.concat_ws(":", category, article_id.cast("string")).alias("source_id"), tier.alias("tier"),
        F.coalesce(T.blank_to_null(url), file_name).alias("source_ref"), article_id.alias("lineage_ref"),
        (~raw).alias("is_approved"), (~raw).alias("is_customer_facing_allowed"), raw.alias("is_internal_only"),
        raw.alias("is_future_only"),
        F.when(raw, "").otherwise(as_of).alias("approved_at"),
        F.when(raw, F.array(F.lit("internal"))).otherwise(F.array(F.lit("customer"), F.lit("internal"))).alias("audience_allowed"),
        T.sha256(content).alias("document_hash"),
    )

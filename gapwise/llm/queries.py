"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> bytes:
    """The public model's file, read by the driver and sent to the tasks as it is."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    from gapwise.llm import pieces

    coded = pieces.encode(table(spark, folder, "documents"), piece_model(), keep=["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    from gapwise.llm import secrets

    kinds = [rule.kind for rule in secrets.BASE_RULES]
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))

    def of(*names):
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds),
        F.sha2(_joined(of(*kinds)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and the verdict of the learned decision list."""
    from gapwise.llm import quality_rules

    judged = quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it comes back from WARC archives, with its place in the order of captures."""
    from gapwise.llm import warc
    from gapwise.llm.common import Scratch

    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    indexed = warc.capture_index(warc.read_archives(spark, path), scratch)
    return indexed.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "capture_rank", "intact")


ORACLES["op10_warc"] = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, url,
         regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM pages
), keyed AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
         CASE WHEN url IS NULL THEN '' ELSE
           array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?]*')), '.')), ',')
           || ')' || substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) END AS url_key,
         1704067200 + page_id AS captured_at
  FROM rows
), first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM keyed WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
       url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) AS capture_rank, true AS intact
FROM keyed LEFT JOIN first USING (payload_digest)
"""


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 0.75 or more on five-word shingles."""
    from gapwise.llm import near_dup

    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document after fuzzy line dedup: its lines, those taken out, and the digest of the rest."""
    from gapwise.llm import line_dedup

    lines = F.size(F.split("text", "\n", -1))
    out = line_dedup.drop_lines(table(spark, folder, "documents").withColumn("n_lines", lines.cast("long")))
    return out.select("doc_id", "n_lines", F.col("n_dropped_lines").cast("long").alias("n_dropped_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Exponents of the margins in the registered query: sources nearly equal, languages and topics half tempered.
MIX_POWER = {"source": 0.2, "lang": 0.5, "topic": 0.5}


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn by raked weights of source, language and topic."""
    from gapwise.llm import mixing

    drawn = mixing.mixed(table(spark, folder, "documents"), power=MIX_POWER)
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), F.round("cell_weight", 12).alias("cell_weight"))


def _mixing_sql(sweeps: int = 24) -> str:
    """The same fit as a chain of windows."""
    margins = ("source", "lang", "topic")
    parts = [
        r"""words AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens
  FROM documents
)""",
        """docs AS (
  SELECT *, CASE WHEN coalesce(length(text) - length(regexp_replace(text, '[|{}<>#*$%&]', '', 'g')), 0) * 5 >= greatest(n_tokens, 1) THEN 'markup'
                 WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic
  FROM words
)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in margins:
        parts.append(f"t_{m} AS (SELECT {m}, t / sum(t) OVER () AS target FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {MIX_POWER[m]}) AS t FROM cells GROUP BY 1))")
    parts.append("w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells)")
    last = "w0"
    for i in range(sweeps):
        for m in margins:
            name = f"w_{i}_{m}"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * t.target / sum(w.weight) OVER (PARTITION BY w.{m}) AS weight FROM {last} w JOIN t_{m} t ON w.{m} = t.{m})"
            )
            last = name
    parts.append(f"fitted AS (SELECT source, lang, topic, weight, weight / tokens / (SELECT max(weight / tokens) FROM {last}) AS probability FROM {last})")
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(probability, 9) AS probability, round(weight, 12) AS cell_weight
FROM docs d JOIN fitted f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic
WHERE CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(text), '')), 1, 13) AS BIGINT)::DOUBLE / pow(16, 13) < probability
"""
    )


ORACLES["op1_mixing"] = _mixing_sql()


@query
def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best inner products of every vector whose id is divisible by 100."""
    from gapwise.llm import mtree

    return mtree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    from gapwise.llm import templates

    found = templates.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that 400-byte repeats cover, and the digest of the rest."""
    from gapwise.llm import suffix_dedup

    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    from gapwise.llm import conversations
    from gapwise.llm.common import Scratch

    found = conversations.repair(conversations.damaged(table(spark, folder, "conversations")), Scratch(spark, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), *conversations.COUNTS, "audit", F.col("repaired").alias("repaired_sha256"))


@query
def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    from gapwise.llm import language
    from gapwise.llm.common import Scratch

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(docs.where("NOT held_out"), Scratch(spark, "language"))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


@query
def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    from gapwise.llm import lexical

    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_search"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT row_number() OVER () AS d, doc_id, w AS words, len(w) AS n FROM words WHERE len(w) > 0
), total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM sized
), items AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
  FROM benchmark
), tf AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(words) AS term FROM sized) SEMI JOIN items USING (term) GROUP BY ALL
), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1
), weights AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total
), scored AS (
  SELECT item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (d), total GROUP BY item_id, d
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored JOIN sized USING (d) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""

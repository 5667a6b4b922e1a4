"""Operators on documents against plain versions, on the smallest tables and on awkward rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from gapwise.llm import line_dedup, mixing, near_dup, quality_rules, secrets, suffix_dedup

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, bucket int, dropped string, node int, topic string"


def awkward():
    """Nulls, empty and very long texts, ties, repeats and near copies."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(300)]
    near = base.copy()
    near[150] = "changed"
    line = "a line of more than forty bytes that stands in several documents"
    texts = [
        None, "", "   \n\t ", "one two", "one two", "ONE Two", long_text, " ".join(base), " ".join(near), " ".join(base[:200]), "ab" * 700,
        "\n".join([line, "x", line, line.replace("several", "several ") + "!", ""]), "é" * 450 + "日本", "é" * 450 + "日本",
        "password = hunter2222 AKIA" + "A1" * 10 + " " + "0af" * 9 + " Token:'abc' API_KEY=\"zzzzzz\"",
    ]
    rows = [(i, t, None if i % 3 else "en", None if i % 5 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows.append((None, "one two", "en", "s0", 3))
    rows.append(rows[7])
    return [(*r, "x", "y", 1, "z", 2, "t") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("which", ["small", "docs"])
def test_repeats(which, request):
    table = request.getfixturevalue(which)
    source = [tuple(r) for r in table.select("doc_id", "text").collect()]
    want = sorted(((i, *x) for (i, _), x in zip(source, brute.repeats([t for _, t in source]))), key=repr)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    got = suffix_dedup.remove_repeats(table).select("doc_id", "n_bytes", removed.alias("n"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h"))
    assert rows_of(got, "doc_id", "n_bytes", "n", "k", "h") == want


def test_repeats_in_hot_buckets(docs, monkeypatch):
    want = rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "spans")
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    assert rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "spans") == want


def test_contexts_of_a_frequent_passage_are_dealt_out(spark):
    """No task of the join by bucket holds a bucket of many contexts."""
    rows = [(7, c) for c in range(4000)] + [(b, c) for b in range(100, 4100) for c in range(1 + b % 2)]
    contexts = spark.createDataFrame(rows, "bucket long, c long").select(
        "bucket", F.xxhash64("bucket", "c").alias("c1"), F.lit(400).alias("windows"), F.struct(F.col("bucket").alias("u1"), F.col("c").alias("u2"), F.lit(0).alias("start")).alias("place"), (F.col("bucket") == 100).alias("loop")
    )
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        met = suffix_dedup._meeting(contexts).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.bucket, r.u2, r.hot) for r in met) == sorted((b, c, b == 7) for b, c in rows if b == 7 or b == 100 or b % 2)
    per_task = [sum(r.task == t for r in met) for t in range(16)]
    assert max(per_task) < 2 * len(met) / 16


@pytest.mark.parametrize("which", ["small", "docs"])
def test_statistics(which, request):
    table = request.getfixturevalue(which)
    want = sorted(((r[0], *brute.statistics(r[1])) for r in table.select("doc_id", "text").collect()), key=repr)
    got = quality_rules.statistics(table)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def test_statistics_of_texts_beyond_the_hash_positions(docs, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 4)
    want = sorted(((r[0], brute.statistics(r[1])[4]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert rows_of(quality_rules.statistics(docs), "doc_id", "n_repeat_words") == want


def test_learned_rules_hold_on_unseen_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    judged = quality_rules.apply_rules(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert counts[0, False] > 0.9 * (counts[0, False] + counts.get((0, True), 0))
    assert counts.get((1, False), 0) < 0.02 * counts[1, True]


def test_rules_without_labels(docs, spark, nothing):
    none = spark.createDataFrame([(None, 0, 0), (1, None, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    judged = quality_rules.apply_rules(docs, none)
    assert judged.where("kept = base_failed").count() == 0
    assert quality_rules.apply_rules(nothing, none).count() == 0


@pytest.mark.parametrize("which", ["small", "docs"])
def test_near_duplicates(which, request):
    table = request.getfixturevalue(which).where("doc_id IS NOT NULL")
    want = brute.near_duplicates([tuple(r) for r in table.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table).collect()}
    assert got == want


def test_near_duplicates_of_null_ids_are_linked(docs):
    found = near_dup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in found] == [(3, False)]


def test_near_duplicates_meet_in_blocks(spark, monkeypatch):
    """A chain of near copies in which no member is like the smallest of its bucket."""
    from gapwise.llm import linking

    monkeypatch.setattr(linking, "BLOCK", 4)
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(10_000)}" for _ in range(120)], []
    for i in range(40):
        base = base.copy()
        base[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table).collect()}
    assert got == brute.near_duplicates([tuple(r) for r in table.collect()])


def test_circulant_signatures_estimate_jaccard():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64)) for _ in range(2)]
    sets[1] = np.unique(np.concatenate((sets[0][:1200], sets[1][:300])))
    shared = len(np.intersect1d(*sets))
    signed = near_dup.Circulant(coordinates=512).signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert abs((signed[0] == signed[1]).mean() - shared / (len(sets[0]) + len(sets[1]) - shared)) < 0.08


@pytest.mark.parametrize("which", ["small", "docs"])
def test_line_dedup(which, request):
    table = request.getfixturevalue(which).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    source = [tuple(r) for r in table.select("doc_id", "text").collect()]
    want = brute.dropped_lines(source, line_dedup.SHINGLE, line_dedup.PERCENT)
    got = {(r.id, r.line_no) for r in line_dedup.duplicate_lines(table).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(table).collect()}
    assert texts == {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t in source}


def test_line_dedup_keeps_columns(docs):
    out = line_dedup.drop_lines(docs)
    assert out.columns == [*docs.columns, "n_dropped_lines"]
    assert out.count() == docs.count()


@pytest.mark.parametrize("which", ["small", "docs"])
def test_secrets(which, request):
    table = request.getfixturevalue(which)
    base = {rule.kind for rule in secrets.BASE_RULES}
    want = sorted(((r[0], brute.secrets(r[1])) for r in table.select("doc_id", "text").collect()), key=repr)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind in base]) for r in secrets.scan(table).collect()), key=repr)
    assert got == want
    assert which == "small" or any(spans for _, spans in want)


def test_trigram_queries_are_necessary():
    texts = ["passwd:abcdef", 'API_KEY="qwerty12"', "apikey=qwerty12", "AKIA" + "Z9" * 10, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40, "xoxb-1234567890ab"]

    def holds(query, text):
        if isinstance(query, bool):
            return query
        if isinstance(query, bytes):
            return query in text.lower().encode()
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])

    found = 0
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule)
        for text in texts:
            if list(rule.spans(text)):
                found += 1
                assert holds(query, text)
        assert rule.kind == "hex" or query is not True
    assert found == len(texts) + 1  # a run of letters a is also a run of hexadecimal digits


def test_mixing_meets_its_targets(spark, small):
    from gapwise.llm.common import Scratch

    counted = small.withColumn("n_tokens", mixing.tokens(F.col("text"))).withColumn("topic", mixing.topic(F.col("text"), F.col("n_tokens")))
    cells = mixing.cells_of(counted)
    fitted = mixing.rake(cells, {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}, Scratch(spark, "test")).collect()
    assert abs(sum(r.weight for r in fitted) - 1) < 1e-9
    assert fitted[0].deviation < 0.05
    drawn = mixing.mixed(small, power={"source": 1.0, "lang": 1.0, "topic": 1.0})
    assert drawn.count() == small.where(F.size(F.split("text", r"\S+")) > 1).count()


def test_mixing_beyond_one_task(small, monkeypatch):
    want = rows_of(mixing.mixed(small, power={"source": 0.3}), "doc_id", F.round("probability", 9))
    monkeypatch.setattr(mixing, "CELLS_PER_TASK", 3)
    assert rows_of(mixing.mixed(small, power={"source": 0.3}), "doc_id", F.round("probability", 9)) == want


def test_mixing_of_rows_without_an_id_and_with_clashing_names(spark):
    marks = ["_n", "_s", "_l", "_t", "_source", "_lang", "_topic", "_w", "_p"]
    rows = [(None, f"{i} " + "word " * 20, "en", "large" if i % 10 else "small") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({m: F.lit(m) for m in marks})
    out = mixing.mixed(table, power={"source": 0.0})
    kept = out.collect()
    assert out.columns[: len(table.columns)] == table.columns and all(r[m] == m for r in kept for m in marks)
    large = [r for r in kept if r.source == "large"]
    assert len(kept) - len(large) == 60 and abs(large[0].probability - 1 / 9) < 1e-6
    assert 30 < len(large) < 95  # 540 rows, each with a draw of its own


def test_empty_tables(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert near_dup.near_duplicates(nothing).count() == 0
    assert line_dedup.drop_lines(nothing).count() == 0
    assert secrets.scan(nothing).count() == 0
    assert mixing.mixed(nothing, power={}).count() == 0


def test_mixing_of_awkward_rows(docs):
    out = mixing.mixed(docs, power={})
    assert out.columns == [*docs.columns, "_topic", "n_tokens", "probability", "cell_weight"]
    assert {r.doc_id for r in out.collect()} >= {3, 6, 7}

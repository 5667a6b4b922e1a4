"""Pieces, pages, vectors, archives and the pipeline."""

import hashlib
import random
import struct

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from session import compare

import __spark_entry__ as entry
import corpus_pipeline
from gapwise.llm import mtree, pieces, templates, warc
from gapwise.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def odd_texts():
    rng = random.Random(4)
    mixed = "".join(rng.choice("abcdefgh ▁é日😀\n\t") for _ in range(4000))
    return ["", " ", "  a  b ", "▁x ▁▁y", "日本語 text 😀é\n\n\t x", "a" * 3000, mixed, "<s></s><unk> <0x0A>", "ﬁne ﬃx ＡＢ　c", "x́ ​"]


def same_as_library(own, library, texts):
    for text in texts:
        ids, begins, ends = own.encode(text)
        want = library.encode(text, return_type="proto").pieces
        data = text.encode()
        assert ids.tolist() == library.encode(text)
        assert [data[a:b] for a, b in zip(begins, ends)] == [p.surface.encode() for p in want]
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_pieces_equal_the_library(model):
    own, library = pieces.Model.load(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    same_as_library(own, library, odd_texts())
    for ids in ([0, 5, 300], [13, 229, 200], [229, 151, 3, 4], [350, 229, 230, 300], [1, 2, 350], []):
        assert own.decode(ids) == library.decode(ids)


def compiled_map(rules):
    """A character map: a double array by the first free base, and the replacements."""
    texts, starts = b"", {}
    for value in rules.values():
        starts.setdefault(value, len(texts))
        texts += value.encode() + b"\0" if starts[value] == len(texts) else b""
    trie = {}
    for key, value in rules.items():
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = starts[value]
    units, used = [0] * 8192, {0}

    def place(node, at):
        base = next(b for b in range(256, 8000) if not any(b ^ c in used for c in node))
        used.update(base ^ c for c in node)
        units[at] |= (at ^ base) << 10 | (256 if 0 in node else 0)
        for byte, child in node.items():
            if byte:
                units[base ^ byte] = byte
                place(child, base ^ byte)
            else:
                units[base] = child | 1 << 31

    place(trie, 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


@pytest.mark.parametrize("squeeze", [0, 1])
def test_pieces_with_a_character_map(model, squeeze):
    """Longest prefixes, replacements longer and shorter than their source, and removed characters."""
    blob = compiled_map({"ﬁ": "fi", "ﬃ": "ffi", "Ａ": "A", "ＡＢ": "ab", "　": " ", "​": "", "\t": " ", "\n": " ", "x́": "X"})

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    spec = b"\x12" + varint(len(blob)) + blob + bytes((0x18, 1, 0x20, squeeze, 0x28, 1))
    changed = model + b"\x1a" + varint(len(spec)) + spec
    own, library = pieces.Model.load(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    same_as_library(own, library, odd_texts())


def test_pieces_of_a_table(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, t, "kept") for i, t in enumerate([None, *odd_texts(), "w " * 100_000])] + [(1, " ", "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(table, model)
    assert coded.columns == ["doc_id", "ids", "begins", "ends"]
    got = sorted((r.doc_id, list(r.ids)) for r in coded.collect())
    assert got == sorted((i, library.encode(t or "")) for i, t, _ in rows)
    back = pieces.decode(coded, model).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((i, library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert pieces.encode(table.limit(0), model).count() == 0


def test_pieces_query(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in entry.queries()["op6_pieces"](spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == brute.sha(library.decode(ids))


@pytest.mark.parametrize("name", ["op1_mixing", "op4_top_k", "op10_warc"])
def test_queries_equal_sql(spark, con, name):
    rows, problem = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None
    assert rows > 0


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute.article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in templates.main_text(pages).collect()} == want


PAGE = """<html><head><title>T</title><script>a("<p>no</p>")</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div id="cookie-notice">Accept?</div>
<article><header><h2>Head&nbsp;line &amp; more</h2></header><p>First   <b>bold</b> <i>text</i>.<p>Second &lt;x&gt;<br>line
<!-- note <p>hidden</p> --><div class="share">Tweet</div><table><tr><td>a<td>b</table><p>{own}<p>Printed by the site</p>
<section class=comments><article><p>A reader says</article></section><form>Mail <input></form></article>
<aside>More</aside><div class="ad banner">Buy</div><footer>&copy; 2024</footer>"""


def test_parts_that_are_no_article():
    text = templates.extract(PAGE.replace("{own}", "Own"), set())
    assert text == "Head line & more\nFirst bold text.\nSecond <x> line\na\nb\nOwn\nPrinted by the site"
    assert templates.extract("<p>plain<ul><li><a href=x>menu</a><li><a>two</a></ul>", set()) == "plain"
    assert templates.extract("<main>in</main>out", set()) == "in"
    assert templates.extract("no markup at all", set()) == "no markup at all"
    assert templates.extract("<article><p>cut off &am", set()) == "cut off &am"
    # Class words are a hint only, and never against what is or holds the article.
    assert templates.extract("<article class='post has-sidebar'><p>Text</article>", set()) == "Text"
    assert templates.extract("<div id='content' class='with-sidebar'><p>Text</div>", set()) == "Text"
    assert templates.extract("<main><h1>Title</h1><p>Intro<article><p>Rest</article></main>", set()) == "Title\nIntro\nRest"
    assert templates.extract("<div><p>A long body text stands here</div><article>teaser</article>", set()) == "A long body text stands here\nteaser"
    assert templates.extract("<p><a href=x>a paragraph that is a link</a>", set()) == "a paragraph that is a link"
    assert templates.extract("<article>A<div class='social-history'>B</div><p class=share-price>C</article>", set()) == "A\nB\nC"
    assert templates.extract("<form id=page><div class=sidebar><main>in the form</main></div><input></form>", set()) == "in the form"
    assert templates.extract("<div class='site-footer'>f</div><div class='cookie-notice'>n</div><div class=ads-2>a</div>kept", set()) == "kept"
    assert templates.extract("", set()) == templates.extract("<", set()).strip("<") == ""


def test_a_template_without_article_elements(spark):
    """Constant words between the slots go, those of single pages stay; a text out of order is no template."""
    page = "<body><div class=top>Daily paper</div><table><tr><td>Section: {a}<td><p>By staff<p>{b}<p>Read on</table>{c}<div>All rights</div>"
    rows = []
    for i in range(24):
        odd = "<div><p>moves</div><p>here</p>" if i % 2 else "<p>here</p><div><p>moves</div>"
        rows.append((i, "http://d.example/" + str(i), page.format(a=f"part {i}", b=f"Story {i} " * 3 + "<br>told", c=odd)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in templates.main_text(table).collect()}
    assert out[5] == "Section: part 5\n" + "Story 5 " * 3 + "told\nmoves\nhere"
    assert out[6] == "Section: part 6\n" + "Story 6 " * 3 + "told\nhere\nmoves"


def test_templates_met_by_host(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("host", F.lit(1)).withColumn("kept", F.lit("x"))
    want = sorted(map(tuple, templates.main_text(pages).collect()))
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", -1)
    assert sorted(map(tuple, templates.main_text(pages).collect())) == want


def test_constant_texts_are_the_template(spark):
    rows = [(i, "https://a.example/" + str(i), PAGE.replace("{own}", f"Own words {i}"), "x") for i in range(20)]
    rows += [(100 + i, "https://b.example/" + str(i), PAGE.replace("{own}", "Same"), "x") for i in range(3)]
    rows += [(200 + i, "https://c.example/", "<article><p>all the same</article>", "x") for i in range(12)]
    rows += [(300, None, None, "x"), (301, "", "", "x"), (None, "https://a.example/1", "<p>" + "long " * 50_000, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in templates.main_text(table).collect()}
    assert len(out) == len(rows)
    assert out[4] == "Own words 4"
    assert out[101].endswith("Same\nPrinted by the site")
    assert out[203] == "all the same"
    assert out[300] == out[301] == ""
    assert len(out[None]) == 5 * 50_000 - 1
    assert templates.main_text(table.limit(0)).count() == 0


def test_top_k_of_awkward_vectors(spark):
    rows = [(i, [float(i % 7), -0.5, 0.25]) for i in range(250)] + [(i, [1.0, 2.0, 3.0]) for i in range(250, 400)]
    rows += [(400, None), (500, []), (600, [1.0, None, 2.0]), (601, [float("nan"), 1.0, 1.0]), (602, [1.0, float("inf"), 0.0]), (None, [1.0, 1.0, 1.0]), (700, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and i < 400}
    want = set()
    for q in (0, 100, 200, 300):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:10], 1)}
    got = mtree.top_k(table, F.col("vec_id") % 100 == 0)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert mtree.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_a_repeated_query_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in [0, 0, 100, *range(1, 60), 7, 7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, vector in whole[:3]:
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:10], 1)]
    got = mtree.top_k(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_tree_spares_distances():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(c, 0.02, (500, 8)) for c in rng.normal(0, 1, (20, 8))])
    vectors = np.floor(vectors * 1024).astype(np.int64)
    tree, computed = mtree.tree_of(vectors), 0
    for q in range(0, len(vectors), 500):
        scores = vectors @ vectors[q]
        scores[q] = -(10**12)
        best = np.lexsort((np.arange(len(scores)), -scores))[:10]
        assert [r for _, r in mtree.search(tree, vectors, vectors[q], 10, np.array([q]))] == best.tolist()
        computed += tree.computed
    assert computed < 20 * len(vectors) / 2  # half of all distances at most


def test_archives_of_awkward_pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5 + "é"
    rows = [(5, "http://x.example/a#f", tricky), (3, "http://x.example/b", tricky), (4, None, None), (6, "", ""), (7, "u\r\nv", "short"), (8, "u", "short"), (9, "HTTP://X.Example/A", "z" * 300_000)]
    rows += [(3, "http://x.example/b", tricky), (None, "http://x.example/c", "null id")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    scratch = Scratch(spark, "test-warc")
    path = scratch.path("archives")
    warc.write_archives(table, path)
    records = warc.capture_index(warc.read_archives(spark, path), scratch).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    want = [(i or 0, len((h or "").encode()), brute.sha(h or ""), "revisit" if i == 5 else "response", 3 if i == 5 else None) for i, _, h in rows]
    assert got == sorted(want)
    assert all(r.intact for r in records)
    order = [(r.url_key, r.captured_at) for r in sorted(records, key=lambda r: r.capture_rank)]
    assert order == sorted(order) and sorted(r.capture_rank for r in records) == list(range(1, len(rows) + 1))
    empty = scratch.path("none")
    warc.write_archives(table.limit(0), empty)
    assert warc.capture_index(warc.read_archives(spark, empty), scratch).count() == 0


def test_archives_of_large_pages_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((50, 7), (500, 2), (None, 1)))
    monkeypatch.setattr(warc, "RANGE_ROWS", 9)
    rows = [(i, f"http://h{i % 3}.example/{'same' if i % 2 else i}", "p" * (i % 40) * (i % 37)) for i in range(200)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = Scratch(spark, "test-warc")
    path = scratch.path("archives")
    warc.write_archives(table, path)
    parsed = warc.read_archives(spark, path)
    held = {(r.archive.rsplit("/", 2)[1], r.n) for r in parsed.groupBy("archive").agg(F.count("*").alias("n")).collect()}
    assert {k for k, _ in held} == {"0", "1", "2"} and all(n <= warc.FILE_CLASSES[int(k)][1] for k, n in held)
    records = warc.capture_index(parsed, scratch).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i) if len(h) >= warc.LEAST_REVISIT else None
    want = [(i, brute.sha(h), None if first.get(h, i) == i else first[h]) for i, _, h in rows]
    assert sorted((r.page_id, r.payload_digest, r.refers_to) for r in records) == [(i, d, r) for i, d, r in want]
    order = [(r.url_key, r.captured_at, r.page_id) for r in sorted(records, key=lambda r: r.capture_rank)]
    assert order == sorted(order) and sorted(r.capture_rank for r in records) == list(range(1, 201))


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_pipeline_stages(spark, model):
    """Every stage on what the one before kept, against plain versions where there are any."""
    from gapwise.llm import line_dedup

    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, outs = source, []
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test-pipeline").put(stage(spark, docs, FOLDER), "stage")
        outs.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == source.columns
    quality, lines, near, mixed, coded = ([r.asDict() for r in o.collect()] for o in outs)
    for row in quality:
        n_words, *_, repeated = brute.statistics(row["text"])
        assert n_words >= 50 and 2 * repeated <= n_words
    gone = brute.dropped_lines([(r["doc_id"], r["text"]) for r in quality], line_dedup.SHINGLE, line_dedup.PERCENT)
    left = {r["doc_id"]: "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in gone) for r in quality}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in left.items() if brute.WORD.search(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    classes = brute.near_duplicates([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in near} == {i for i, (_, c) in classes.items() if i == c}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and len(mixed) > len(near) / 2
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert {r["doc_id"]: list(r["ids"]) for r in coded} == {i: library.encode(t) for i, t in texts.items()}


def test_stages_on_awkward_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (3, "w " * 60, "en", "s", 120), (3, "w " * 60, "en", "s", 120), (4, " ".join(f"x{i}" for i in range(90)), "de", "t", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() == (1 if table.count() else 0)

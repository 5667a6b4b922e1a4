"""Different texts under one id, or without one, are different documents."""

import corpus_pipeline
from gapwise.llm import line_dedup, near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TWICE = "a line that stands in two of the documents"


def test_lines_of_rows_without_an_id(spark):
    texts = [f"{TWICE}\nfirst of one\nsecond of one", f"own words\n{TWICE}\n{TWICE}", "plain\nno copy\nstays here", f"{TWICE}\nother\nlast line"]
    for ids in ([None] * 4, [7] * 4):
        rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts)]
        out = [r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
        lines = sorted(x for t in out for x in t.split("\n"))
        assert len(out) == 4 and lines == sorted({x for t in texts for x in t.split("\n")})


def test_near_copies_under_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "changed"]
    other = [f"v{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (3, " ".join(near)), (3, " ".join(other)), (3, " ".join(other)), (1, " ".join(reversed(other))), (2, " ".join([*reversed(other)][:59])), (2, " "), (None, " ".join(words)), (None, " ".join(near))]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert len(out) == len(set(out)) == 4  # rows without an id are linked as all others
    assert len(set(out) & {rows[0], rows[1]}) == 1
    assert {rows[2], rows[4], rows[6]} <= set(out)
    found = near_dup.near_duplicates(table).collect()
    assert len(found) == len(rows) and {r.component_id for r in found if r.doc_id == 2 and r.n_shingles} == {1}
    assert {(r.component_id, r.kept) for r in found if r.doc_id is None} == {(3, False)}


def test_a_chain_through_a_row_without_an_id(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [base, [*base[:74], *(f"a{i}" for i in range(6))], [*(f"b{i}" for i in range(6)), *base[6:74], *(f"a{i}" for i in range(6))]]
    rows = [(5, " ".join(texts[0])), (None, " ".join(texts[1])), (9, " ".join(texts[2])), (None, "only words of its own here stand")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, u1 int, u2 int")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(table).collect()}
    assert got == {(5, 5, True), (None, 5, False), (9, 5, False), (None, None, True)}
    kept = near_dup.kept_documents(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {5, None}


def test_very_long_unrelated_texts_share_no_band():
    import numpy as np

    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, 2_000_000).astype(np.uint64)) for _ in range(2)]
    signed = near_dup.Circulant().signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert (signed[0] == signed[1]).mean() < 0.05
    keys = near_dup.band_keys(signed, near_dup.ROWS)
    assert not (keys[0] == keys[1]).any()

"""Line dedup without any least length, against a plain version of its own."""

import brute
import numpy as np
import pyarrow as pa

from gapwise.llm import line_dedup
from gapwise.llm.near_dup import text_bytes

FOLDER = "/root/testdata/sf0.001"


def dropped(rows):
    """Places that are not the first of their component; lines without a shingle are linked by equality."""
    return brute.dropped_lines(rows, line_dedup.SHINGLE, line_dedup.PERCENT)


def found(table):
    return {(r.id, r.line_no) for r in line_dedup.duplicate_lines(table).collect()}


def test_short_lines_take_part(spark):
    near = "Read more about it at the end of the page"
    rows = [
        (1, "Les.\nown words of one\nRead more\n\n \nLes."), (2, "Les.\nRead more\n\n \nlast"), (3, "é\nLES.\nRead more!\n" + near), (4, "é\n \n" + near + "s"),
        (5, None), (6, " \nOne two"), (7, "short line one\nshort line two\n12345678"), (8, "12345678\n1234567\n1234567"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(table)
    assert got == dropped(rows)
    assert {(1, 5), (2, 0), (2, 1), (4, 0), (6, 0), (8, 0), (8, 2)} <= got and not got & {(2, 2), (2, 3), (3, 1)}
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(table).collect()}
    assert texts[2] == "\n \nlast" and texts[5] is None


def test_all_lines_of_the_documents(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(table) == dropped([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_many_lines_to_drop(spark):
    """A text of very many lines, half of them copies, in one pass."""
    import time

    from pyspark.sql import functions as F

    n = 200_000
    table = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")), "\n").alias("text"), F.sequence(F.lit(0), F.lit(n - 1), F.lit(2)).alias("gone"))
    start = time.time()
    got = table.select(line_dedup._without("text", F.col("gone"))).first()[0]
    assert got == "\n".join(str(i) for i in range(1, n, 2)) and time.time() - start < 30


def test_similar_pairs_equals_plain_sets():
    random = np.random.default_rng(5)
    left, right = [], []
    for size in (8, 9, 20, 200, 3_000):
        for changed in (0, 1, 2, size // 20, size // 10, size):
            line = "".join(random.choice(list("abcé "), size))
            edited = list(line)
            for at in random.integers(0, size, changed):
                edited[at] = "x"
            left.append(line)
            right.append("".join(edited))
    left.append("aaaaaaaa" * 50)  # one shingle, many times
    right.append("aaaaaaaab")

    def shingles(line):
        data = line.encode()
        return {data[i : i + line_dedup.SHINGLE] for i in range(len(data) - line_dedup.SHINGLE + 1)}

    want = []
    for x, y in zip(map(shingles, left), map(shingles, right), strict=True):
        want.append(100 * len(x & y) >= line_dedup.PERCENT * len(x | y))
    assert line_dedup.similar_pairs(pa.array(left), pa.array(right)).tolist() == want
    assert True in want and False in want


def test_signatures_do_not_depend_on_the_step(monkeypatch):
    random = np.random.default_rng(6)
    lines = ["".join(random.choice(list("abcdefgh "), size)) for size in (8, 5_000, 9, 700, 64, 2_000, 8)]
    data, edges = text_bytes(pa.array(lines))
    whole = line_dedup.signatures(data, edges)
    for step in (1, 100, 1_000):
        monkeypatch.setattr(line_dedup, "CACHED_BYTES", step)
        assert (line_dedup.signatures(data, edges) == whole).all()

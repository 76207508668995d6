import random
from collections import Counter

import pytest

import corpus_pipeline
from flowloom.llm import line_dedup, queries
from tests.llm import data


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2))
        for edits in (1, 2, 3):
            assert line_dedup.near(a, b, edits) == line_dedup.trimmed_near(a, b, edits) == (distance(a, b) <= edits)


def edited():
    """Texts of a few lines, half of them with up to three edits at random places; one template with many variants."""
    rng = random.Random(2)
    pool = [" ".join(rng.choice(data.VOCABULARY) for _ in range(rng.randrange(4, 16))) for _ in range(60)]
    rows = data.odd_rows()[-14:]
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at, kind = rng.randrange(len(line)), rng.randrange(3)
                line[at : at + (kind != 2)] = [] if kind == 0 else [rng.choice("xyé")]
            lines.append("".join(line))
        rows.append(data.row(5000 + i, "\n".join(lines)))
    return rows + [data.row(6000 + i, f"the same long line of words with one number {i:04d} at its end") for i in range(50)]


def compared(rows):
    return {x for r in rows for line in (r[1] or "").split("\n") if len(data.words(x := line)) >= 5}


@pytest.mark.parametrize("long", [2048, 8])
def test_links(spark, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    rows = edited()
    lines = sorted(x.encode() for x in compared(rows) if len(x.encode()) >= 32 and len(x) < 1000)
    expected = sum(line_dedup.trimmed_near(a, b) for i, a in enumerate(lines) for b in lines[:i])
    found = [tuple(r) for r in line_dedup.links(spark.createDataFrame(rows, data.SCHEMA)).collect()]
    assert len(found) == len(set(found)) == expected > 100


def test_texts_keep_first_lines(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    left = line_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    lines = sorted((x for x in compared(rows)), key=lambda x: x.encode())
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a.encode()), len(b.encode())) >= 32 and len(a) < 1000 and line_dedup.trimmed_near(a.encode(), b.encode()):
                root[find(a)] = find(b)
    seen, expected = set(), Counter()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line in (r[1] or "").split("\n"):
            if line in root:
                if find(line) in seen:
                    continue
                seen.add(find(line))
            keep.append(line)
        text = "\n".join(keep) if r[1] is not None else None
        if text == r[1] or data.words(text):
            expected[(r[0], text)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == expected
    assert line_dedup.deduplicated(spark.createDataFrame([], data.SCHEMA)).count() == 0


def test_first_occurrence_without_id(spark):
    """A line shared by a row without id and another stays in the row without id."""
    line = "one line of several words that two documents have"
    rows = [data.row(7, f"{line}\nand a line of the document with an id"), data.row(None, f"a line before it in the other\n{line}"), data.row(9, line)]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    left = {(r["doc_id"], r["text"]) for r in line_dedup.deduplicated(docs).collect()}
    assert left == {(7, "and a line of the document with an id"), (None, f"a line before it in the other\n{line}")}
    found = line_dedup.classes(docs, line_dedup.occurrences(docs)).filter("copies = 3").collect()
    assert [(r["first"]["d"], r["first"]["number"]) for r in found] == [(None, 1)]


def test_every_line_in_query_and_pipeline(spark, tmp_path):
    """Few words, and none between spaces: equal lines are repeats, near ones of 32 bytes and more too."""
    chinese = "这一行没有空格所以只算一个词但是它很长"
    texts = ["yes\n" + chinese + "\nno more", " \nyes\nfirst of its kind", chinese + "x\n \nyes ", "short\n\nshort\nshorn"]
    docs = spark.createDataFrame([data.row(i, x) for i, x in enumerate(texts)], data.SCHEMA)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert left == {0: texts[0], 1: " \nfirst of its kind", 2: " \nyes ", 3: "short\n\nshorn"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_line_dedup(spark, str(tmp_path)).collect()
    assert len(found) == len({line for x in texts for line in x.split("\n") if line.strip()})
    assert Counter(r["copies"] for r in found) == {1: 6, 2: 2} and sum(not r["kept"] for r in found) == 1


@pytest.mark.parametrize("long", [2048, 8])
def test_components_of_long_lists_equal_those_of_all_links(spark, monkeypatch, long):
    """Also where a line is near none of a list's pivots."""
    monkeypatch.setattr(line_dedup, "LONG", long)
    rng = random.Random(11)
    rows = edited() + [data.row(7000 + i, f"one template that goes on {rng.randrange(10**6):06d} and on with a number in it") for i in range(150)]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    wanted = line_dedup.graph.components(line_dedup.links(docs))
    found = line_dedup.components(docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import merkle
from flowloom.llm.queries import manifest_rows
from tests.llm import data


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def piece(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    found = []
    for level in levels[:-1]:
        found += [level[i ^ 1]] if (i ^ 1) < len(level) else []
        i >>= 1
    return found


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of every row, each tree in memory."""
    leaf = {i: sha(*map(piece, (r[0], r[3], r[2], r[4], r[1]))) for i, r in enumerate(rows)}
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        members = sorted((i for i, r in enumerate(rows) if r[2] == lang), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        trees[lang] = members, levels_of([leaf[i] for i in members])
    top = levels_of([trees[x][1][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        members, levels = trees[lang]
        for j, i in enumerate(members):
            out.append((rows[i][0], leaf[i], levels[-1][0], top[-1][0], sha(*siblings(levels, j), *siblings(top, at))))
    return sorted(out, key=str)


def found(spark, rows):
    got = manifest_rows(spark.createDataFrame(rows, data.SCHEMA)).collect()
    for r in got:
        assert r["verified"] == (r["folded_root"] == r["root"])
    return got


@pytest.mark.parametrize(("height", "part"), [(10, 200_000), (2, 7), (1, 30)])
def test_against_plain_trees(spark, monkeypatch, height, part):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "PART", part)
    rows = data.odd_rows() + [data.row(500 + i, "t", f"l{i % 5}" if i else "", None) for i in range(11)] + [data.row(900, "alone", "é")]
    rows += [data.row(None, None, None, None)] * 3
    got = found(spark, rows)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=str) == plain(rows)
    import zlib

    for r in got:
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] != touched


def test_nulls_stay_when_tampered(spark):
    rows = [(i, "x", "en", None, None if i % 2 else 5, 1, 1, True, "k") for i in range(60)]
    got = found(spark, rows)
    assert all(r["verified"] for r in got if r["doc_id"] % 2) and not all(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [data.row(i, f"text {i}") for i in range(n)]
    got = found(spark, rows)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=str) == plain(rows)


def test_queue_holds_a_message_per_level(monkeypatch):
    most = 0
    push = merkle.heapq.heappush

    def counting(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", counting)
    leaves = [sha(str(i)) for i in range(1000)]
    levels = merkle.forward(leaves, 10)
    assert levels == levels_of(leaves) and most <= 11
    proofs = {}
    merkle.backward(levels, None, proofs.__setitem__)
    assert most <= 12
    for i in random.Random(1).sample(range(1000), 50):
        node, step = leaves[i], proofs[i]
        while step is not None:
            node, step = sha(step[0], node, step[1]), step[2]
        assert node == levels[-1][0]


def test_own_columns_and_proofs(spark):
    table = spark.createDataFrame([(i, f"g{i % 3}", "w" * i) for i in range(20)], "id long, tree string, digest string")
    out = merkle.manifest(table, merkle.leaf_digest([F.col("id"), F.col("digest")]), F.col("tree"), F.col("id"), {"digest": F.col("digest"), "tree": F.col("tree")})
    assert out.columns == ["digest", "tree", "leaf", "subroot", "root", "proof"]
    assert out.filter(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20
    assert out.filter(merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowloom.llm import packing
from tests.llm import data

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return np.array([*EXACT.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)


def test_pieces_give_back_the_tokens(spark):
    rows = data.odd_rows() + [data.row(200, "a <|endoftext|> b"), data.row(201, "日本語 テキスト")]
    found = packing.packed(spark.createDataFrame(rows, data.SCHEMA), with_ids=True).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(ids(r[1]))
    for doc, expected in texts.items():
        pieces = sorted((r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in found if r["doc_id"] == doc)
        assert sum(p[1] for p in pieces) == sum(map(len, expected))
        whole = expected[0]  # rows of one id have one text here
        for start, length, piece, crc, tokens in pieces:
            part = whole[start : start + length]
            assert tuple(part) == piece and crc == zlib.crc32(part.tobytes()) and tokens == len(whole)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(r["length"] for r in found)
    assert used > 0.95 * 1024 * (len(bins) - 1)


def test_cuts_cover_every_length():
    for tokens in range(1, 3000):
        pieces = packing.cuts(tokens)
        assert pieces[0][0] == 0 and sum(p[1] for p in pieces) == tokens
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        assert all(1 <= length <= 1024 // k for _, length, k in pieces)


def test_both_libraries_agree_on_usual_characters():
    usual = [chr(c) for c in range(0x250) if not packing._UNUSUAL.search(chr(c))]
    for c in usual:
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}1", f"1{c}'s\n{c}\t {c}"):
            assert packing.encode(text)[:-1].tolist() == EXACT.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], data.SCHEMA)).count() == 0

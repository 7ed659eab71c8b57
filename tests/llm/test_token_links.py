"""Cross-tokenizer alignment against plain loops over token spans, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidelog.llm import token_links
from tidelog.llm.base import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "\n", "a", "  two  blanks ", "<|endoftext|> <s> </s> <unk> <0x0A>", "é́ ﬁ 中文字 👍🏽👍🏽 ▁▁ 　x", "\x00\x01",
       "I'll they’ve 1234567 ٣٤ don't", "👩‍👩‍👧‍👦" * 9, "ааа ббб" * 20, "\r\n\t tab", "x" * 5000, "=" * 300, "one two one two"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{token_links.FOLDER}/{token_links.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{token_links.FOLDER}/{token_links.FILE_B}")


def brute(rows, tokenizers):
    a, b = tokenizers
    letters = token_links.byte_letters()
    docs = []
    for i, text in rows:
        groups, whole = [], (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if text and b"".join(raw_a) == whole == b"".join(raw_b):
            end_a = end_b = 0
            own, other = [], []
            left_b = list(zip(ids_b, raw_b, strict=True))
            for x, r in zip(ids_a, raw_a, strict=True):
                own.append(x)
                end_a += len(r)
                while end_b < end_a:
                    y, q = left_b.pop(0)
                    other.append(y)
                    end_b += len(q)
                if end_a == end_b:
                    groups.append((own, other))
                    own, other = [], []
        else:
            ids_a = ids_b = []
        docs.append((i, len(ids_a), len(ids_b), groups))
    held = Counter()
    for *_, groups in docs:
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, n_a, n_b, groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_pairs", [1, 40, 1 << 20])
def test_odd_texts(spark, tokenizers, block_pairs):
    rows = [*enumerate(ODD), (None, "a b c"), (None, None), (3, "a b"), (3, "a b"), (-7, "a b")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, block int, pairs int").repartition(3)
    out = token_links.align(docs, block_pairs=block_pairs)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, tokenizers)


def test_whole_table(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_token_links"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, tokenizers)


def test_empty_table_and_broken_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_links.align(docs).collect() == []
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF' AS STRING) AS text")
    assert tuple(token_links.align(broken).first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_both_libraries_encode_alike(tokenizers):
    """Every code point in some surroundings, and random mixes of what splits words."""
    pair = token_links.Pair(*token_links.read_files(token_links.FOLDER, token_links.FILE_A, token_links.FILE_B))
    texts = []
    for start in range(0, 0x110000, 64):
        some = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        texts.append(" ".join(f"a{c}b 1{c}2 {c}{c}  {c}\t{c}.{c}" for c in some))
    rng = random.Random(1)
    pool = [" ", "  ", "\n", "'", "s", "'LL", "’s", "ab", "é", "1", "<|endoftext|>", "　", "...", "\x1c", "\x85", "​", "中", "👍", "\r\n"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    want = [e.ids for e in tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [pair._a.encode_ordinary(" " + t) for t in texts] == want


def test_a_group_too_large_to_expand():
    """Sides that share no end but the last, and small groups around them."""
    rng = random.Random(7)
    pair = SimpleNamespace(width_a=np.array([2, 2, 5]), width_b=np.array([1, 2, 2, 5]), bytes_a=[b""] * 3, bytes_b=[b""] * 4,
                           names=[f"{i}{e}" for n, ends in ((3, ",|"), (4, ",;")) for i in range(n) for e in ends])
    side_a = [rng.randrange(2) for _ in range(32)]
    side_b = [0, *[rng.choice((1, 2)) for _ in range(31)], 0]
    links = token_links.Alignment(pair, [2, *side_a, 2, *side_a], [3, *side_b, 3, *side_b])
    want = Counter([(2, 3)] * 2 + [(x, y) for x in side_a for y in side_b] * 2)
    got = links.whole()
    assert got.n_groups == 4 and got.n_links == sum(want.values()) > token_links.EXPANDED
    assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == {4 * x + y: n for (x, y), n in want.items()}
    said = f"2|3;{','.join(map(str, side_a))}|{','.join(map(str, side_b))}"
    assert got.groups == f"{said};{said}"
    # The same in two stretches.
    cut = links.cut(links.ends[[1, 3]])
    assert [c[0] for c in cut] == [f"{said};"] * 2 and [c[2:] for c in cut] == [(33, 34)] * 2
    assert b"".join(c[1] for c in cut) == np.array([4 * x + y for xs, ys in [([2], [3]), (side_a, side_b)] * 2 for x in xs for y in ys]).tobytes()


@pytest.mark.parametrize("kept", [3, 1 << 17])
def test_segments_give_what_whole_texts_give(monkeypatch, kept):
    monkeypatch.setattr(token_links, "KEPT_SEGMENTS", kept)
    pair = token_links.Pair(*token_links.read_files(token_links.FOLDER, token_links.FILE_A, token_links.FILE_B))
    assert pair.by_segment
    rng = random.Random(3)
    pool = ["a", "bc", "Wort", "né", " ", "  ", "\n", " \n", "\n ", "\t", "\x1c ", "\x85", "　", "中文", "👍", "don't", "12", "...", " end", "x" * 90]
    for _ in range(600):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 16)))
        parts = token_links.segments(text)
        assert " ".join(parts) == text
        got, want = pair.align(text.encode()), token_links.Alignment(pair, *pair._encode(text)).whole()
        assert (got.groups, *got[3:]) == (want.groups, *want[3:]), text
        assert got.pairs.tolist() == want.pairs.tolist() and got.times.tolist() == want.times.tolist()

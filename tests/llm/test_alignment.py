"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from relaynote.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a  b", "a\n b", "x \n  y ", "▁q", "<|endoftext|> hi", "<s> </s>", "\x00a\x01", "é́ﬁ①", "​  z", "it's 'S don't",
       "a" * 3000, "ab " * 500, "  a", "日本語 テキスト", "😀😀 😀", "\x1c b", "\x85 c", "a　 b", " lead", "trail "]


def byte_of_char():
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plain(rows):
    """The contract's columns, without segments, caches, blocks or arrays."""
    of_a, of_b, byte_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_char()
    of_a.encode_special_tokens = True
    out, linked, held = [], [], Counter()
    for d, text in rows:
        sides = [[], []]
        if text:
            sides[0] = [(i, bytes(byte_of[c] for c in of_a.id_to_token(i))) for i in of_a.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, of_b.id_to_piece(i)) for i in of_b.encode(text)]
            sides[1] = [(i, bytes([int(p[3:5], 16)]) if of_b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
                sides = [[], []]
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in sides]
        groups, links, before = [], Counter(), 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            one, two = ([i for (i, _), e in zip(s, es) if before < e <= cut] for s, es in zip(sides, ends))
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
            links.update((x, y) for x in one for y in two)
            before = cut
        held.update(set(links))
        linked.append(links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if sides[0] else ""
        out.append([d, len(sides[0]), len(sides[1]), len(groups), sum(links.values()), sha])
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    best = [sum(m for p, m in links.items() if held[p] == most[p[0]]) for links in linked]
    sums = [sum(m * held[p] for p, m in links.items()) for links in linked]
    return sorted(((*o[:5], b, s, o[5]) for o, b, s in zip(out, best, sums)), key=repr)


@pytest.mark.parametrize(("block", "at_once"), [(alignment.BLOCK, alignment.BROADCAST), (512, 300)])
def test_alignment_is_that_of_the_plain_version(spark, block, at_once):
    rnd = random.Random(1)
    words = ["the", " ", "  ", "\n", "é", "'s", "9", "日", "<0x41>", " word"]
    rows = [*enumerate(ODD), (3, "  "), (3, "  "), (None, "x y"), (None, "x z"), (None, None), (None, None)]  # repeated rows, null ids
    rows += [(100 + i, "".join(rnd.choice([*words, "▁" if i % 9 == 0 else "q"]) for _ in range(60))) for i in range(150)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, side string, copies int")
    got = [tuple(r) for r in alignment.align(docs, A, B, block, at_once).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_a_large_group_has_its_links_counted_by_pair():
    """Groups beyond WRITTEN links are counted by their different ids; both ways give the same pairs."""
    rnd = np.random.default_rng(3)
    len_a, len_b = np.array([2, 4]), np.array([3, 9])
    a = rnd.integers(0, 2, 30)
    a = np.append(a, np.zeros((-len_a[a].sum() % 6) // 2, np.int64))
    b = np.zeros(len_a[a].sum() // 3, np.int64)
    found = []
    for most in (1 << 16, 3):
        before, alignment.WRITTEN = alignment.WRITTEN, most
        try:
            doc = alignment._Open((0, 0, 1))
            alignment.close_groups([(doc, a, b)], len_a, len_b)
            found.append(doc.row())
        finally:
            alignment.WRITTEN = before
    assert found[0] == found[1] and found[0][5] > 30


def test_empty_table_gives_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []

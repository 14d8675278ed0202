"""Alignments of whole texts against both tokenizers run on each whole text."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import alignment
from plumeline.llm.alignment import align, aligned, linked, op13_alignment, tokenizers, verified

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


def brute(rows):
    a, b, a_bytes, b_bytes = tokenizers(*PATHS)
    held, counts = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes[x] for x in one) == whole == b"".join(b_bytes[x] for x in two):
                ends_a, ends_b, at = {0: 0}, {0: 0}, 0
                for k, x in enumerate(one):
                    at += len(a_bytes[x])
                    ends_a[at] = k + 1
                at = 0
                for k, x in enumerate(two):
                    at += len(b_bytes[x])
                    ends_b[at] = k + 1
                both = sorted(ends_a.keys() & ends_b.keys())
                groups = [(one[ends_a[x] : ends_a[y]], two[ends_b[x] : ends_b[y]]) for x, y in zip(both, both[1:])]
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        held.append((i, groups, links))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = Counter()
    for i, groups, links in held:
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out[i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), shown] += 1
    return out, counts


ODD = [
    "a  b\n c é ﬁ 　x", "x ", "x  ", " x", "  x", "\n\nx", " ", "\t \t", "don't we'll  I'd", "<|endoftext|> and </s> <s>", "tab\tsep \t mix", "nbsp  x　 y  z\u0085 w", "日本語 の テキスト", "▁ under ▁bar",
    "emoji 👩‍👩‍👧 x", "\x00 nul \x1c fs", "ctrl\x7f del", "a" * 3000 + " " + "b" * 3000, "12,345 67.89  -1", "é combining ́x", "​ zero", "﻿ bom x", "line\r\n  next",
]


def test_tokens_of_segments_are_those_of_the_whole(spark, table, edge_docs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 4000)
    monkeypatch.setattr(alignment, "CHUNK", 700)
    monkeypatch.setattr(alignment, "CODES", 100)
    rows = [(i, t) for i, t, _, _ in edge_docs] + [(100 + k, t) for k, t in enumerate(ODD)] + [((1 << 60) + 1, "big id")]
    found, links = align(table([(i, t, None, None) for i, t in rows]), *PATHS)
    want, counts = brute(rows)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert {(r.a, r.b): r.n for r in links.collect()} == counts
    assert align(table([]), *PATHS)[0].count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\u00a0\u3000▁éab',.1日", "  ", "the"]), min_size=1, max_size=60).map("".join))
def test_cuts_are_safe(text):
    import numpy as np

    data = np.frombuffer((" " + text).encode(), np.uint8)
    starts = alignment.cuts(data, np.array([0, len(data)]), verified(*PATHS))
    parts = [bytes(data[x:y]).decode() for x, y in zip(starts, [*starts[1:], len(data)])]
    a, b, _, _ = tokenizers(*PATHS)
    assert "".join(parts) == " " + text
    assert [i for p in parts for i in a.encode(p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in b.encode(p[1:])] == b.encode(text)


def test_groups():
    a_bytes, b_bytes = [b" a", b"b", b"cd"], [b" ab", b"c", b"d", b" a"]
    shown = aligned([" abcd", " a", " abcd"], [[0, 1, 2], [0], [0, 1, 2]], [[0, 1, 2], [3], [0, 1]], a_bytes, b_bytes)
    assert shown == ["0,1|0;2|1,2", "0|3", None]
    assert linked(shown[0]) == (3, 3, 2, [0, 1 << 32, 2 << 32 | 1, 2 << 32 | 2])
    assert linked(shown[1]) == (1, 1, 1, [3])


def test_unsafe_vocabularies_are_refused(tmp_path):
    import json

    said = json.loads(open(PATHS[0], encoding="utf-8").read())
    said["pre_tokenizer"]["use_regex"] = False
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said))
    with pytest.raises(ValueError, match="byte-level"):
        verified(str(other), PATHS[1])


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([tuple(r) for r in docs])
    want = Counter({(*row[:7], hashlib.sha256(row[7].encode()).hexdigest() if row[7] else ""): n for row, n in want.items()})
    assert Counter(tuple(r) for r in op13_alignment(spark, DATA).collect()) == want

"""Phrases against a count of every run of words."""

import re
from collections import Counter, defaultdict

import pytest

from plumeline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    rows = defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [b for (m, q), b in found.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= C.WITHIN * a for b in longer):
            rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("longest", "top", "bits"), [(3, 2000, 28), (3, 7, 16), (4, 2000, 28)])
def test_phrases(spark, table, edge_docs, monkeypatch, longest, top, bits):
    monkeypatch.setattr(C, "MOST_BITS", bits)
    monkeypatch.setattr(C, "SLICE", 3000)
    rows = [(t, lang) for _, t, lang, _ in edge_docs if t is None or len(t) < 20_000] + [("new york city. New  York\tcity; york new\nyork", "en")] * 11 + [("Ünter den Linden, den linden den linden", "")] * 6 + [("a a a a a a a a a a a a", None)]
    got = {tuple(r) for r in C.collocations(table([(i, t, lang, None) for i, (t, lang) in enumerate(rows)]), longest, 5, top).collect()}
    assert got == brute(rows, longest, 5, top)


def test_long_runs_and_empty_tables(spark, table):
    rows = [(1, "long " * 60_000, "en", None), (2, "y" * 100_000, None, None), (3, "", "en", None), (4, None, None, None)]
    assert {(r.phrase, r.a, r.l, r.r, r.n) for r in C.collocations(table(rows)).collect()} == {("long long long", 59_998, 60_000, 59_999, 60_000)}
    assert C.collocations(table([])).count() == 0


def test_products_beyond_64_bits(spark):
    of = lambda *rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    big = 3 * 10**12
    found = [of(("en", "a", big + 1), ("en", "b", big + 7)), of(("en", "a b", big))]
    assert [tuple(r) for r in C.scored(found).collect()] == [("en", "a b", big, big + 1, big + 7, 10**6 * big * big // ((big + 1) * (big + 7)))]


def test_a_full_bitmap_changes_no_result(spark, table, monkeypatch):
    rows = [(i, f"w{i % 40} x{i % 7} z{i % 3} the end of w{i % 11}", "en", None) for i in range(400)]
    want = {tuple(r) for r in C.collocations(table(rows)).collect()}
    monkeypatch.setattr(C, "_bitmap", lambda level: b"\xff" * 8)
    assert {tuple(r) for r in C.collocations(table(rows)).collect()} == want

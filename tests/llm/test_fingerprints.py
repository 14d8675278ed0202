"""Fingerprints against a plain version of the sampling, and against the similarity that they stand for."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from plumeline.llm import fingerprints as P


def h64(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & (1 << 64) - 1).to_bytes(8, "little") if not isinstance(p, np.int32) else int(p).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def samples(text):
    bag = Counter(re.findall("[^\x20\x09-\x0d]+", text))
    if not bag:
        return None
    out = []
    for k in range(P.SAMPLES // P._ROW):
        for i in range(P._ROW):
            best = None
            for word, w in bag.items():
                h = h64(h64(h64(word), np.int32(k)) ^ i)
                g = h64(h)
                r = 44 * math.log(2) - math.log(((h >> 42) + 0.5) * ((h >> 20 & (1 << 22) - 1) + 0.5))
                c = math.log(64 * math.log(2) - math.log(((g >> 32) + 0.5) * ((g & (1 << 32) - 1) + 0.5)))
                b = (h & (1 << 20) - 1) / (1 << 20)
                n = math.floor(math.log(w) / r + b)
                best = min(best or (math.inf, 0), (int((c - r * (n - b + 1) + 128) * 2.0**35), (g ^ n) & (1 << 20) - 1))
            out.append(best[1])
    return out


def like(a, b):
    return 1.0 if a is b is None else 0.0 if a is None or b is None else sum(x == y for x, y in zip(a, b)) / P.SAMPLES


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out, made = [], {}
    of = lambda t: made.setdefault(t, samples(t))
    show = lambda s: "".join(f"{x:05X}" for x in s or ())
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(of(text)), show(of(edited)), like(of(text), of(edited)), like(of(text), of(after))))
    return Counter(out)


@pytest.mark.parametrize("width", ["2", "8"])
def test_fingerprints(spark, table, edge_docs, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    rows = [(i, t[:3000] if t and i == 46 else t) for i, t, _, _ in edge_docs if i not in (50, 51, None)]
    rows += [(60, "日本語 の テキスト x y z"), (61, "é" * 10), (62, " a  b\tc\n"), (-5, "negative id and more words"), (1 << 62, "a big id"), (50, "same"), (50, "same"), (None, "nobody's"), (None, "nobody's")]
    try:
        assert Counter(tuple(r) for r in P.fingerprints(table([(*r, None, None) for r in rows])).collect()) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_tables(spark, table):
    assert P.fingerprints(table([])).count() == 0
    for rows in ([(None, None)], [(3, "one two three")], [(None, "a b"), (None, "a b")]):
        assert Counter(tuple(r) for r in P.fingerprints(table([(*r, None, None) for r in rows])).collect()) == brute(rows)


def test_rows_that_share_an_id(spark, table):
    rows = [(1, "x y"), (1, "z"), (1, None), (2, "p q r"), (None, "m"), (None, "n o")]
    found = P.fingerprints(table([(*r, None, None) for r in rows])).collect()
    assert Counter(r.n_chars for r in found) == Counter(len(t or "") for _, t in rows)


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in range(400):
        a, b = rng.integers(0, 9, 40) * rng.random(40), rng.integers(0, 9, 40) * rng.random(40)
        b[: key % 40] = a[: key % 40]
        rows += [(key, int(t), float(x), float(y)) for t, x, y in zip(rng.integers(0, 1 << 62, 40), a, b)]
        want[key] = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = P.signatures(spark.createDataFrame(rows, "key long, t long, a double, b double"), ["key"], ["a", "b"])
    error = np.array([r.near - want[r.key] for r in found.select("key", P.likeness(found.a, found.b).alias("near")).collect()])
    assert abs(error.mean()) < 0.015 and np.sqrt((error**2).mean()) < 0.1  # 32 samples: 0.088 at most


def test_real_table(spark):
    found = P.op11_fingerprints(spark, "/root/testdata/sf0.001").toPandas()
    assert found["near_edited"].mean() > 0.45 and found["near_next"].mean() < 0.15

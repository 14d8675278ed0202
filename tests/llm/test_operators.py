"""Operators against brute force, over rows with nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.llm import decontaminate, exact_dedup, mixing, near_dedup, pii, quality, suffix_dedup, toxicity, url_filter
from plumeline.llm import jvm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    rows = [(1, "https://A.Example.org/es/x"), (2, "http://example.org/en/1?q"), (3, "http://example.org/en/2"), (4, "https://b.example.com/fr/1"), (5, "http://x.com/de/"), (6, "http://www.bad.net/p/"), (7, "https://bad.net/p#x"), (8, "http://bad.net/q"),
            (9, None), (10, "no scheme"), (11, "://"), (12, "http://notexample.org"), (13, "http://EXAMPLE.org?x=/es/"), (6, "http://www.bad.net/p/"), (None, "http://bad.net/p?z")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS canon", "2 AS host", "3 AS block")
    listed = spark.createDataFrame([("http://m.bad.net/p",), (None,), ("junk",)], "url string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect())
    want = Counter(
        [
            (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"), (3, "example.org", "/en/2", "org/", "allow"), (4, "b.example.com", "/fr/1", "com/fr/", "allow"),
            (5, "x.com", "/de/", "com/de/", "block"), (6, "www.bad.net", "/p/", None, "block"), (7, "bad.net", "/p", None, "block"), (8, "bad.net", "/q", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"),
            (11, "", "", None, "allow"), (12, "notexample.org", "", None, "allow"), (13, "example.org", "", None, "allow"), (6, "www.bad.net", "/p/", None, "block"), (None, "bad.net", "/p", None, "block"),
        ]
    )
    assert got == want
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}
    long = "http://long.net/" + "p/" * 500_000
    far = spark.createDataFrame([(1, long), (2, long + "x"), (3, long + "?q")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in url_filter.judge(far, far.where("page_id = 1").select("url")).collect()} == {(1, "block"), (2, "allow"), (3, "block")}


def test_filter_lets_few_through_and_join_removes_them(spark):
    """Of canons that are not listed the filter alone passes some; after the join none is left."""
    listed = spark.range(4000).selectExpr("concat('h', id, '.net/p') AS canon")
    probes = spark.range(60_000).selectExpr("concat('h', id, '.net/p') AS canon")
    blocks = max(1, -(-4000 * url_filter.BITS_PER_URL // 512))
    held = probes.select("canon", url_filter._block(blocks).alias("block"), *[url_filter._bit(k).alias(f"b{k}") for k in range(8)]).join(url_filter.bloom_blocks(listed, blocks), "block")
    passed = held.where(" and ".join(f"(shiftright(w{k}, b{k}) & 1) = 1" for k in range(8))).count()
    assert 4000 < passed < 4000 + 0.02 * 56_000
    assert {r.canon for r in url_filter.listed_hits(probes, listed).collect()} == {r.canon for r in listed.collect()}


# ---------------------------------------------------------------- exact copies


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.integers(0, 2**64 - 1))
def test_fuse_filter_has_every_key(keys, other):
    held = np.array(sorted(keys), np.uint64)
    built = exact_dedup.build_fuse(held)
    assert exact_dedup.probe_fuse(held, *built).all()
    assert len(exact_dedup.probe_fuse(np.array([other], np.uint64), *built)) == 1


def test_fuse_filter_is_selective():
    rng = np.random.default_rng(5)
    keys, others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    built = exact_dedup.build_fuse(keys)
    assert exact_dedup.probe_fuse(keys, *built).all() and len(built[3]) < 1.4 * len(keys)
    assert exact_dedup.probe_fuse(others, *built).mean() < 0.01


def test_exact_groups(table, edge_docs):
    for incoming in (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(True), F.lit(False)):
        rows, groups = exact_dedup.exact_groups(table(edge_docs), incoming)
        got = Counter((r.doc_id, r.keep_id, r.group_size) for r in rows.join(groups, "digest").collect())
        by = defaultdict(list)
        for doc_id, text, *_ in edge_docs:
            by[text or ""].append(doc_id)
        best = lambda ids: max((i for i in ids if i is not None), default=None)
        assert got == Counter((d, best(by[t or ""]), len(by[t or ""])) for d, t, *_ in edge_docs)
    rows, groups = exact_dedup.exact_groups(table([]), F.lit(True))
    assert rows.count() == groups.count() == 0


def test_exact_groups_either_way(table, edge_docs, monkeypatch):
    """Repeated digests sent to all tasks or joined, batches in one part or many: the same groups; and a snapshot serves twice."""
    incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    found = lambda: Counter(map(tuple, exact_dedup.exact_groups(table(edge_docs), incoming)[1].collect()))
    want = found()
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 1)
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 1)
    assert found() == want
    rows = table(edge_docs, clash=False).selectExpr("doc_id", "unhex(sha2(coalesce(text, ''), 256)) AS digest").cache()
    held = exact_dedup.snapshot(rows.where("doc_id < 40"))
    for part in ("doc_id < 40", "doc_id >= 40"):
        batch = exact_dedup._grouped(rows.where(part))
        known = {bytes(r.digest) for r in rows.where("doc_id < 40").collect()}
        assert all(r.maybe for r in exact_dedup.screen(batch, held).collect() if bytes(r.digest) in known)


# ---------------------------------------------------------------- mixing


def reshared(sizes):
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, active = {}, set(order)
    while active:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[k] for k in active)
        over = [k for k in active if level * weight[k] > 2 * sizes[k]]
        if not over:
            return target | {k: level * weight[k] for k in active}
        for k in over:
            target[k] = 2.0 * sizes[k]
            active.discard(k)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(f"s{i:02d}" if i else None): int(rng.choice([0, 1, 10, 1000, 50_000])) for i in range(14)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mix(table, edge_docs):
    rng = np.random.default_rng(3)
    more = edge_docs + [(1000 + i, "w " * int(rng.integers(1, 40)), "en", f"s{i % 5}") for i in range(600)]
    got = mixing.mix(table(more)).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, *_ in more)
    sizes = Counter()
    for _, t, _, s in more:
        sizes[s] += size(t)
    target, taken, most = reshared(sizes), Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert Counter(got) == Counter(mixing.mix(table(more, clash=False)).collect())
    assert mixing.mix(table([])).count() == 0
    # a source whose rows have no ids still comes near its target
    bare = mixing.mix(table([(None, f"{i} " + "w " * 9, "en", "s0") for i in range(600)] + [(i, "w " * 10, "en", "s1") for i in range(600)])).collect()
    for s in ("s0", "s1"):
        assert abs(sum(r.taken for r in bare if r.source == s) - next(r.target for r in bare if r.source == s)) <= 10
    rows = mixing.mixed_rows(table(more, clash=False))
    assert Counter((r.doc_id, r.text) for r in rows.collect() if r.doc_id is not None and r.doc_id >= 1000) == Counter({(d, t): 0 for d, t, *_ in more if 0}) + Counter(
        {(r.doc_id, dict((d, t) for d, t, *_ in more if d is not None and d >= 1000)[r.doc_id]): r.taken // r.size for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.taken}
    )


# ---------------------------------------------------------------- benchmark windows


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_contamination(spark, table, edge_docs):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    base = word(edge_docs[20][1])
    items = [("b1", " ".join(base[20:45])), ("b2", " ".join(base[100:104])), ("b3", "nothing like this is found in any of the texts at all"), ("b4", "WORD"), ("b5", None), ("b6", "..."), (None, " ".join(base[40:60])), ("b1", " ".join(base[70:90])), ("b7", "y" * 100_000)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(table(edge_docs), spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS words")).collect()))
    want = []
    for d, t, *_ in edge_docs:
        words, hit, names = word(t), set(), set()
        for name, text in items:
            w = word(text)
            n = min(10, len(w))
            for at in range(len(words) - n + 1) if n else ():
                if tuple(words[at : at + n]) in set(windows(w, n)):
                    hit |= set(range(at, at + n))
                    names.add(name or "")
        want.append((d is None, d or 0, len(words), len(hit), tuple(sorted(names))))
    assert got == sorted(want)
    assert decontaminate.contamination(table([]), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert decontaminate.contamination(table(edge_docs), spark.createDataFrame([], "item_id string, text string")).where("n_hit > 0").count() == 0


# ---------------------------------------------------------------- near copies


def test_near_duplicates(table, edge_docs):
    rng = np.random.default_rng(11)
    base, rows = [f"t{i}" for i in rng.integers(0, 5000, 900)], list(edge_docs)
    rows += [(1990 + i, thue_morse(n, letters), "en", "s0") for i, (n, letters) in enumerate((n, x) for n in (1024, 4096) for x in ("ab", "ba"))]
    for i in range(60):  # copies with ever more changes, small and large
        words = list(base[: [60, 300, 900][i % 3]])
        for at in rng.integers(0, len(words), int(len(words) * (i / 60) * 0.08)):
            words[at] = f"z{rng.integers(0, 10**6)}"
        rows.append((2000 + i, " ".join(words), "en", "s0"))
    for i in range(150):  # one template, changed in as many places as leaves two copies about the bound
        words = list(base[300 : 300 + 150])
        for at in rng.integers(0, len(words), 1 + i % 6):
            words[at] = f"y{rng.integers(0, 10**6)}"
        rows.append((3000 + i, " ".join(words), "en", "s0"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(rows)).collect())
    word = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    sets = [set(windows(w, 5)) if len(w := word(t)) >= 5 else ({tuple(w)} if w else set()) for _, t, *_ in rows]
    group = list(range(len(rows)))
    root = lambda i: i if group[i] == i else root(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    assert got == Counter((d, len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, *_) in enumerate(rows))
    assert near_dedup.near_duplicates(table([])).count() == 0


def test_components(spark):
    from plumeline.llm.components import components

    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, int(k)) for k in rng.integers(1000, 2000, 300)] + [tuple(map(int, e)) for e in rng.integers(3000, 3400, (180, 2))] + [(5, 5)]
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame([(b, a) for a, b in edges], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in least} and len(got) == len(least)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_wide_sets_with_colliding_halves():
    from plumeline.llm import kernel as K

    x, y = np.array([[1, 1], [1, 2], [3, 1]], np.uint64), np.array([[1, 2], [1, 3], [3, 1], [4, 4]], np.uint64)
    assert K.shared_count(x, y) == 2 and K.shared_count(x[2:], y) == 1


# ---------------------------------------------------------------- repeated spans


def test_repeated_spans(table, edge_docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha256) for r in suffix_dedup.repeated_spans(table(edge_docs)).collect())
    first, want = {}, Counter()
    order = sorted(edge_docs, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t, *_ in order:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], (d is None, d or 0))
    for d, t, *_ in order:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < (d is None, d or 0):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        want[(d, len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0, sha(kept))] += 1
    assert got == want
    assert suffix_dedup.repeated_spans(table([])).count() == 0


def test_many_frames_take_the_other_way(table, monkeypatch):
    """Anchors with more frames than are sorted in one task give the same spans."""
    rows = [(i, f"{i:040d} a passage that all of them share {i * 7919:040d}" * 2, "en", "s") for i in range(12)]
    want = {tuple(r) for r in suffix_dedup.repeated_spans(table(rows)).collect()}
    monkeypatch.setattr(suffix_dedup, "MOST_FRAMES", 1)
    assert {tuple(r) for r in suffix_dedup.repeated_spans(table(rows)).collect()} == want


def test_deep_shallow_order(spark):
    """Strings of SPAN bytes, most with long common prefixes, come out in order, equal ones marked."""
    jvm.register(spark, *suffix_dedup._SORT)
    rng, runs = np.random.default_rng(6), []
    for n in (1, 2, 3, 10, 60, 400):
        for letters, same in ((2, 0), (2, 20), (200, 0), (3, 45), (256, 49)):
            head = rng.integers(0, 256, same, dtype=np.uint8).tobytes()
            runs.append([head + rng.integers(0, letters, 50 - same, dtype=np.uint8).tobytes() for _ in range(n)])
            runs[-1] += [runs[-1][int(k)] for k in rng.integers(0, n, n // 2)]
    frame = spark.createDataFrame([(i, [bytearray(x) for x in r]) for i, r in enumerate(runs)], "i int, x array<binary>")
    for r in frame.selectExpr("x", "plumeline_suffix_order(x) AS o").collect():
        strings = [bytes(r.x[k >> 1]) for k in r.o]
        assert strings == sorted(bytes(x) for x in r.x) and sorted(k >> 1 for k in r.o) == list(range(len(r.x)))
        assert [k & 1 for k in r.o] == [int(i > 0 and strings[i] == strings[i - 1]) for i in range(len(strings))]


# ---------------------------------------------------------------- tokens


def coded(spark, runs):
    """Round trips of runs of ids through the JVM's coder: (coded, decoded) of each."""
    from plumeline.llm.token_output import _CODER

    jvm.register(spark, *_CODER)
    frame = spark.createDataFrame([(i, bytearray(np.array(r, "<u4").tobytes())) for i, r in enumerate(runs)], "i int, ids binary")
    rows = frame.selectExpr("i", "plumeline_encode_ids(ids) AS c").selectExpr("i", "c", "plumeline_decode_ids(c) AS d").orderBy("i").collect()
    return [(bytes(r.c), np.frombuffer(bytes(r.d), "<u4").tolist()) for r in rows]


def test_range_coder_round_trip(spark):
    rng = np.random.default_rng(8)
    runs = [rng.integers(0, most, n).tolist() for most in (1, 2, 5, 300, 65_536, 65_537, 1 << 29) for n in (0, 1, 2, 40, 4095, 4096, 4097, 9000)]
    runs += [[7] * 10_000, list(range(10_000)), [5, 9, 60_000, 7] * 3000, (rng.zipf(1.2, 20_000) % 49_000).tolist()]
    for run, (_, back) in zip(runs, coded(spark, runs), strict=True):
        assert back == run


def test_range_coder_learns_and_notices_damage(spark):
    import zlib

    rng = np.random.default_rng(3)
    ids = np.concatenate([[5, 9, 60_000, 7] * 3000, rng.zipf(1.3, 30_000) % 49_000])
    ((blocks, _),) = coded(spark, [ids.tolist()])
    assert len(blocks) < sum(len(zlib.compress(ids[k : k + 4096].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), 4096))
    for at in (0, 4, 12, 20, len(blocks) // 3):
        damaged = bytearray(blocks)
        damaged[at] ^= 0xFF
        with pytest.raises(Exception, match="damaged|checksum"):
            spark.createDataFrame([(damaged,)], "c binary").selectExpr("plumeline_decode_ids(c)").collect()
    with pytest.raises(Exception, match="ids must be in"):
        coded(spark, [[1 << 29]])


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_word_hashes_tell_structured_words_apart():
    from plumeline.llm import kernel as K

    rng = np.random.default_rng(1)
    found = ["".join(rng.choice(list("ab"), n)) for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(60)]
    found += [thue_morse(n, letters) for n in (8, 16, 64, 1024, 2048, 4096) for letters in ("ab", "ba")]
    found = sorted(set(found))
    data = np.frombuffer(" ".join(found).encode(), np.uint8)
    for salt in (0, 1):
        starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.NOT_SPACE)
        assert len(set(K.Bytes(data).hashes(starts, ends, salt).tolist())) == len(found)


def test_run_cache_gives_the_librarys_ids():
    import random

    import pyarrow as pa

    P = pytest.importorskip("public_tokenizers")
    from plumeline.llm import kernel as K
    from plumeline.llm.token_output import WordEncoder

    encoder, rng = WordEncoder(P.path("word_bpe_49k.json")), random.Random(4)
    parts = [*"abzSsTtD.,!-%~12 \t\n'", "'s", "'re", "'LL", "'", "|", "é", "e\u0301", "\u0301", "İ", "ß", "ſ", "\u3000", "ﬁ", "中", "٣", "word", "Hello"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(8000)]
    texts += [f"{thue_morse(1024)} {thue_morse(1024, 'ba')}", "a" * 17, "ab" * 9 + " " + "ab" * 9 + "c", "<|endoftext|> <|STARTOFTEXT|>"]
    for part in (texts[:-1], texts[-1:], texts[:-1]):
        for a, b, data, offsets in K.slices(pa.array(part)):
            ids, at = encoder.encode(data, offsets)
            for i in range(b - a):
                assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(part[a + i], add_special_tokens=False).ids, part[a + i]


def test_token_files(spark, table, edge_docs, tmp_path):
    import zlib

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from plumeline.llm.token_output import read_tokens, token_digests, write_tokens

    odd = [(100, "it's <|endoftext|> <|STARTOFTEXT|> a.b, C, d.. é. 12,5", "en", "s"), (101, "tabs\tand spaces　 é ﬁ İ", "en", "s")]
    rows = edge_docs + odd
    path = write_tokens(table(rows), f"file://{tmp_path}/t", P.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    read = read_tokens(spark, path).collect()
    assert sorted((r.start, len(r.ids)) for r in read) == sorted((r.start, r.n_tokens) for r in token_digests(spark, path).collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == Counter((d, tuple(ids[t])) for d, t, *_ in rows)
    ordered = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == sorted((d is not None, d or 0) for d, *_ in rows)
    assert {(r.doc_id, r.ids_crc32) for r in ordered if r.doc_id == 100} == {(100, zlib.crc32(np.array(ids[odd[0][1]], "<u4").tobytes()))}
    assert token_digests(spark, write_tokens(table([]), f"file://{tmp_path}/none", P.path("word_bpe_49k.json"))).count() == 0


# ---------------------------------------------------------------- classifiers


def labelled(n=700):
    rng, docs, labels = np.random.default_rng(2), [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 400, int(rng.integers(30, 90)))]
        toxic = i % 7 == 0
        if toxic:
            words[int(rng.integers(0, len(words)))] = ["idiot", "grelling", "grellast", "vormund"][i % 4]
        good = i % 3 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:20]) * 3
        docs.append((i, text, "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_classifiers(spark, table, edge_docs):
    docs, labels = labelled()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "0 AS score", "1 AS label")
    for run, part, column in ((quality.quality_scores, 3, 1), (toxicity.toxicity_scores, 5, 2)):
        learnt = quality.bucket_of_id(F.col("doc_id"), part) != 0
        got = run(table(docs + edge_docs), marks, learnt).collect()
        assert len(got) == len(docs) + len(edge_docs) and all(0 <= r.score <= 1 for r in got)
        held = {i for i in range(100, 700) if __import__("zlib").crc32(str(i).encode()) % part == 0}
        right = [(r.score >= 0.5) == bool(labels[r.doc_id][column]) for r in got if r.doc_id in held]
        assert np.mean(right) > 0.93
        assert run(table([]), marks, learnt).count() == 0
        bare = run(table(docs[:20]), marks.limit(0), learnt).collect()
        assert len(bare) == 20 and all(0 <= r.score <= 1 for r in bare)


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    total = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
    return {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]


def test_personal_data(table, edge_docs):
    odd = [
        "a@b.c_x@y.z a.b@c x@y..z q@w.e.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 12.3.4.5.6 1.2.3", "4111 1111-1111 1111 411111111111111111111111 4111111111111111", "+1 (2)3-4-5 6 7 8. +12 +4930123456789 ++1 234 567 890",
        "\x01a@b.com\x01 \U0001f389 c@d.org", "mail joe [at] site dot com, call (212) 555-1234, password=abc123def456", "@" * 2000 + "a" * 3000 + "@x.y", "1" * 5000 + "." + "2.3.4", "." * 3000 + "@a.b",
    ]
    rows = edge_docs + [(200 + i, t, "en", "s") for i, t in enumerate(odd)]
    got = {(r.doc_id, r.base): r.spans for r in pii.personal_data(table(rows)).select("doc_id", pii._listed("base").alias("base"), pii._listed("spans").alias("spans")).collect()}
    for d, t, *_ in rows:
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group()))
        assert (d, want) in got
        assert set(filter(None, want.split(","))) <= set(got[d, want].split(","))
    assert pii.personal_data(table([])).count() == 0


def planted():
    """(doc_id, text, kind, start, end) of spans that only the method finds, and texts with decoys."""
    rng = np.random.default_rng(12)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    mixed = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPabcdefghjkmnp23456789"), n))
    digit = lambda n: "".join(rng.choice(list("0123456789"), n))

    def amex() -> str:
        while True:
            number = "37" + digit(13)
            if valid("card", "0" + number):
                return f"{number[:4]} {number[4:10]} {number[10:]}"

    forms = {
        "secret": lambda i: [('token = "', hexes(40), '" th'), ("password: ", mixed(14), " and"), ("key ", "AKIA" + mixed(16).upper().replace("0", "2"), " there"), ("api_key='", mixed(24) + "7a", "'")][i % 4],
        "email": lambda i: [("mail to ", f"jane.doe{i} [at] example{i} [dot] com", " now"), ("contact ", f"bob{i} (at) site{i} (dot) org", ".")][i % 2],
        "phone": lambda i: [("call ", f"(21{i % 9}) 5{i % 90 + 10}-{1000 + 7 * i}", " today"), ("tel ", f"31{i % 9}-6{i % 90 + 10}-{2013 + 11 * i}", ",")][i % 2],
        "card": lambda i: ("paid by card ", amex(), " ok"),
        "ip": lambda i: ("server address ", "2001:db8:" + ":".join(hexes(4) for _ in range(6)), " up"),
    }
    rows, spans = [], []
    for k, (kind, form) in enumerate(forms.items()):
        for i in range(60):
            before, value, after = form(i)
            head = " ".join(f"w{x}" for x in rng.integers(0, 999, 5)) + " " + before
            rows.append((1000 * k + i, f"{head}{value}{after}", "en", "s"))
            spans.append((1000 * k + i, kind, len(head), len(head) + len(value)))
    base = [(7000 + i, f"write to a{i}@b{i}.com or call +1 212 555 {1000 + i}, host 10.0.{i}.7", "en", "s") for i in range(60)]
    decoys = [(8000 + i, [f"the secret: something{'ly' * (i % 3)} odd", f"part 1000 200000 {30000 + i} of it", f"rows 100-100-{1000 + i} here", f"a token = {'a' * (8 + i % 5)}"][i % 4], "en", "s") for i in range(60)]
    return rows, spans, base, decoys


def test_method_adds_spans(table):
    rows, spans, base, decoys = planted()
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(table(rows + base + decoys)).select("doc_id", pii._listed("spans").alias("spans")).collect()}
    for kind in pii.KINDS:
        mine = [(d, f"{k}:{a}:{b}") for d, k, a, b in spans if k == kind]
        assert sum(x in got[d] for d, x in mine) >= 0.9 * len(mine), kind
    assert sum(bool(got[d]) for d, *_ in decoys) <= 0.3 * len(decoys)


def test_many_matches_take_linear_time(table):
    import time

    rows = [(1, "12a 1.2.3.4 " * 40_000, "en", "s"), (2, "12a " * 1_000_000, "en", "s"), (3, "1234 567890 12345 " * 30_000, "en", "s"), (4, "7" * 1_000_000, "en", "s")]
    began = time.time()
    got = {r.doc_id: r.n for r in pii.personal_data(table(rows)).select("doc_id", F.size("base").alias("n")).collect()}
    assert got == {1: 40_000, 2: 0, 3: got[3], 4: 0} and time.time() - began < 60


def test_reliabilities_tell_labelers_apart():
    rng, rates, counts = np.random.default_rng(5), {0: [0.1, 0.2, 0.3, 0.5, 0.4, 0.5], 1: [0.95, 0.9, 0.8, 0.9, 0.85, 0.9]}, Counter()
    truth = Counter()
    for _ in range(4000):
        y = int(rng.random() < 0.5)
        votes = sum(int(rng.random() < p) << j for j, p in enumerate(rates[y]))
        base = pii.BASE_SPAN if y and rng.random() < 0.2 else pii.PROPOSED
        counts["phone", votes, base] += 1
        truth[votes, y] += base == pii.PROPOSED
    rows = [(k, v, b, n) for (k, v, b), n in sorted(counts.items())]
    found = pii.reliabilities(rows)
    for j, (wrong, right) in enumerate(found["theta"]["phone"]):
        assert abs(wrong - rates[0][j]) < 0.08 and abs(right - rates[1][j]) < 0.08
    weights, bias = pii.span_classifier(rows, found["posterior"])
    says = lambda v: bias["phone"] + sum(w for j, w in enumerate(weights["phone"]) if v >> j & 1) > 0
    assert sum(n for (v, y), n in truth.items() if says(v) == bool(y)) > 0.9 * sum(truth.values())


def test_more_votes_never_lower_a_posterior():
    """Spans of which all labelers speak for the right ones, but hardly any base span has a context word."""
    full, no_context = (1 << len(pii.LABELERS)) - 1, (1 << len(pii.LABELERS)) - 1 - 4
    counts = [("phone", no_context, pii.BASE_SPAN, 3000), ("phone", 0, pii.DECOY, 40), ("secret", full, pii.PROPOSED, 150), ("secret", full - 1, pii.PROPOSED, 16)]
    found = pii.reliabilities(counts)
    assert all(wrong <= right for of in found["theta"].values() for wrong, right in of)
    assert found["posterior"]["secret", full, pii.PROPOSED] > 0.9 and found["posterior"]["secret", full, pii.PROPOSED] >= found["posterior"]["secret", full - 1, pii.PROPOSED]
    weights, bias = pii.span_classifier(counts, found["posterior"])
    assert bias["secret"] + sum(weights["secret"]) > 0


@pytest.mark.parametrize("sf, least", [("sf0.01", 11), ("sf0.1", 150)])
def test_secrets_of_the_tables(spark, sf, least):
    """Every token = "<hex>" is found; hashes without such a name, and refused cards and addresses, are not."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer("(?i)token = \"([0-9a-f]{32,64})\"", t)}
    got = {(r.doc_id, *map(int, s.split(":")[1:])) for r in pii.op8_pii(spark, f"/root/testdata/{sf}").collect() for s in r.spans.split(",") if s.startswith("secret:")}
    assert len(want & got) >= max(least, 0.95 * len(want))
    assert all(re.search("(?i)(token|secret|password|key)\\W{0,6}$", texts[i][max(0, a - 20) : a]) or re.match("AKIA|gh[pousr]_|sk-|[0-9a-fA-F]{32}", texts[i][a:b]) for i, a, b in got)

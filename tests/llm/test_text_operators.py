"""Mixing, packing, quality, language, line dedup, near-dedup: brute force on small tables, and edge cases."""

import collections
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone import scratch
from siltstone.llm import components, langid, linededup, mixing, neardup, packing, quality, textbytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, __salt string, id long, component string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, "x", "y", 5, "z") for r in rows], SCHEMA)


def edge_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), ) for i in range(60)]
    rows += [(60, None, "en", "a"), (61, "", "en", "a"), (62, " \t\n ", None, None), (63, text(5000), "fr", "b"), (64, "x" * 100_000, "en", "é")]
    rows += [(65, "same row", "en", "a")] * 3 + [(None, "no id here", "en", "a"), (66, "12 34 ...", "en", "zz"), (67, "Ünïcödé ßtraße 東京", "fr", "b")]
    return rows


def size_of(text):
    return len(WORDS.findall(text or ""))


def expected_targets(sizes, weights=(1, 2, 3), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s] + 1e-9]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        for s in over:
            capped[s] = cap * sizes[s]
            left -= capped[s]


def test_mixing_against_brute_force(spark):
    rows = edge_rows()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    want = expected_targets(sizes)
    docs = frame(spark, rows)
    runs = [mixing.taken_words(mixing.mix(docs, block_words=16, shard_slots=32)).collect() for _ in range(2)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    assert len(runs[0]) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in runs[0]:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert collections.Counter(r["size"] for r in runs[0]) == collections.Counter(size_of(r[1]) for r in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mixing_text_matches_the_plan(spark):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] not in (65,)]
    docs = frame(spark, rows)
    options = {"block_words": 16, "shard_slots": 32}
    want = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(docs, **options)).collect()}
    got = collections.Counter()
    texts = {r[0]: r[1] for r in rows}
    out = mixing.mixed_documents(docs, **options)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in out.collect():
        got[r["doc_id"]] += size_of(r["text"])
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_mixing_of_equal_rows_and_ids(spark):
    """Rows without id and of one size spread over buckets; exact repeats are documents of their own."""
    rows = [(None, f"a{i} b{i} c{i}", "en", "a") for i in range(300)] + [(7, "same words here again", "en", "b")] * 50
    docs = frame(spark, rows)
    plan = mixing.mix(docs, block_words=16, shard_slots=32)
    assert plan.documents.where("doc_id is null").select("bucket").distinct().count() > 10
    want = {s: t for s, t in expected_targets({"a": 900, "b": 200}).items()}
    out = mixing.taken_words(plan).collect()
    assert len(out) == 350 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    taken = collections.Counter()
    for r in out:
        taken["b" if r["doc_id"] == 7 else "a"] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    words = collections.Counter()
    for r in mixing.mixed_documents(docs, block_words=16, shard_slots=32).collect():
        words[r["source"]] += size_of(r["text"])
    assert words == taken


def test_mixing_splits_a_long_text_once(spark):
    """Every taken segment is cut from one split of the text: a million words take seconds."""
    text = " ".join(f"w{i}" for i in range(1_000_000))
    docs = frame(spark, [(1, text, "en", "a"), (2, "x y", "en", "b")])
    began = time.monotonic()
    out = mixing.mixed_documents(docs).agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.count(F.lit(1)), F.min("n_chars")).first()
    assert time.monotonic() - began < 60
    assert abs(out[0] - 1_000_002) <= 2 and out[1] > 1900 and out[2] > 0


def test_permutation_is_exact(spark):
    for n in (1, 2, 3, 7, 64, 100):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1), F.lit(2)).alias("p"))
        assert sorted(r["p"] for r in out.collect()) == list(range(n))


def test_mixing_of_an_empty_table(spark):
    docs = frame(spark, [])
    assert mixing.taken_words(mixing.mix(docs)).count() == 0
    assert mixing.mixed_documents(docs).count() == 0


def padding(bounds, lengths, counts):
    return sum((min(b for b in bounds if b >= x) - x) * n for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 5)
        best = min(padding([*c, lengths[-1]], lengths, counts) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= k and padding(found, lengths, counts) == best


def test_boundaries_of_many_lengths():
    """Against the plain quadratic programme, with all lengths kept apart."""
    rng = random.Random(7)
    for n, k in ((300, 16), (150, 5), (400, 2), (60, 60), (200, 1)):
        lengths = sorted(rng.sample(range(100_000), n))
        counts = [rng.choice([1, 2, 1000]) for _ in lengths]
        rows = [0, *itertools.accumulate(counts)]
        best = [x * r for x, r in zip(lengths, rows[1:], strict=True)]
        for _ in range(k - 1):
            best = [min([best[j], *(best[i] + lengths[j] * (rows[j + 1] - rows[i + 1]) for i in range(j))]) for j in range(n)]
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= k and padding(found, lengths, counts) == best[-1] - sum(x * c for x, c in zip(lengths, counts, strict=True))


def test_packing(spark):
    rows = edge_rows()
    out = packing.pack(frame(spark, rows), buckets=4, budget=200, keep=("text",)).collect()
    assert collections.Counter(r["text"] for r in out) == collections.Counter(r[1] for r in rows)
    bins = collections.defaultdict(list)
    for r in out:
        assert r["n_tokens"] == size_of(r["text"]) and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        bins[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), own in bins.items():
        room = max(1, 200 // max(1, own[0]["bucket_len"]))
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) <= room
        if (bucket, batch + 1) in bins:
            assert len(own) == room
    lengths = sorted(collections.Counter(size_of(r[1]) for r in rows).items())
    best = packing.boundaries([x for x, _ in lengths], [n for _, n in lengths], 4)
    assert {r["bucket_len"] for r in out} <= set(best)
    assert packing.pack(frame(spark, [])).count() == 0


# -- words and shingles


def test_words_and_lines_match_python():
    texts = ["", "a", " a  b\tc\n", "ÀB c\x0bd", "x" * 3000 + " y", "\n\n", "a\nb c\n", None, "A b A b A b"]
    data, at = textbytes.buffers(pa.array(texts))
    hashes, s, e, first = textbytes.word_spans(data, at, lower=True)
    for i, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(own)
        assert [bytes(data[a:b]).lower() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] == own
    names = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for w, h in zip((t or "").encode().lower().split(), hashes[first[i] : first[i + 1]], strict=True):
            names[w].add(h)
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
    lines, _, count, first = textbytes.line_spans(data, at)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        assert first[i + 1] - first[i] == len(own)
        assert list(count[first[i] : first[i + 1]]) == [len(x.encode().split()) for x in own]


def brute_components(rows, k, percent):
    sets, ids = {}, sorted({r[0] for r in rows if r[0] is not None})
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = [(r[0], r[1]) for r in edge_rows()]
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    at = 1000
    for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 3, 2, 1, 0):  # a chain of near copies around the threshold
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
        rows.append((at, " ".join(copy)))
        at += 1
        if edits == 3:
            base = copy
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "one"), (2003, None), (2004, "")]
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    out = neardup.near_duplicates(docs, k, percent).collect()
    assert len(out) == len(rows)
    want = brute_components(rows, k, percent)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(frame(spark, []), k, percent).count() == 0


def test_links_that_the_star_misses(spark):
    """A group in which many members are near others but not near its least id."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(6):  # each group's centre is far from the others, its members are near the centre
        centre = list(base)
        for p in range(g * 14, g * 14 + 14):
            centre[p] = f"g{g}p{p}"
        for m in range(8):
            copy = list(centre)
            copy[199 - m] = f"m{g}{m}{rng.randint(0, 99)}"
            rows.append((g * 100 + m, " ".join(copy)))
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert out == brute_components(rows, 3, 85)


def components_found(spark, rows, k=3, percent=85):
    out = neardup.near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in rows]), k, percent).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: r["component_id"] for r in out}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are one node: each text's links count."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda words, i: " ".join([*words[:i], "other", *words[i + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 58)), (3, near(b, 58)), (4, " ".join(c))]
    assert components_found(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4} == brute_components(rows, 3, 85)
    rows += [(9, " ".join(b)), (9, near(c, 59)), (9, ""), (7, None), (7, near(c, 0)), (8, None), (9, " ".join(b))]
    assert components_found(spark, rows) == dict.fromkeys((1, 2, 3, 4, 7, 9), 1) | {8: 8} == brute_components(rows, 3, 85)


@pytest.mark.parametrize("limits", [{"BLOCK": 8, "STAR": 3, "PART_ROWS": 3}, {"PART_SHINGLES": 300}])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, limits):
    """Buckets of many components, cut by size, block and part, against brute force."""
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(6)
    rows, base = [], [f"w{i}" for i in range(150)]
    for g in range(8):  # centres are alike enough to share buckets, but not linked
        centre = list(base) + [f"t{g}x{i}" for i in range(3 * g)]
        for p in range(g * 9, g * 9 + 9):
            centre[p] = f"g{g}p{p}"
        for m in range(6):
            copy = list(centre)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(100, 150)] = f"m{rng.randint(0, 99)}"
            rows.append((g * 100 + m, " ".join(copy)))
    rng.shuffle(rows)
    want = brute_components(rows, 3, 85)
    assert 2 < len(set(want.values())) < 40
    assert components_found(spark, rows) == want


def test_near_duplicates_of_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(2_400_000))
    assert len(text) > 20_000_000
    rows = [(3, text), (5, text + " end"), (7, "start " + text), (8, text[: len(text) // 2]), (9, "w" * 3_000_000), (11, "w" * 3_000_000)]
    assert components_found(spark, rows, 5, 80) == {3: 3, 5: 3, 7: 3, 8: 8, 9: 9, 11: 9}


def test_words_by_pieces(monkeypatch):
    """Words, lines and hashes don't depend on how a slice is cut into pieces."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\né東") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", None, "x" * 300]
    data, at = textbytes.buffers(pa.array(texts))
    found = []
    for piece in (7, 64, textbytes.PIECE):
        monkeypatch.setattr(textbytes, "PIECE", piece)
        textbytes._powers.__defaults__[0].clear()
        found.append([*textbytes.word_spans(data, at, lower=True), *textbytes.line_spans(data, at)])
    textbytes._powers.__defaults__[0].clear()
    for other in found[:2]:
        assert all((x == y).all() for x, y in zip(other, found[2], strict=True))


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
    for share in (0.7, 0.85, 0.95):
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.int64).astype(np.uint64)])
        samples = neardup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 2000, 4000]))
        x, y = neardup.odd_sketches(samples)
        z = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        estimate = 1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * z / neardup.BITS)
        assert abs(estimate - share) < 0.15


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert all(out.get(x, x) == up[x] for x in up)


# -- lines


def test_patience():
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert linededup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert linededup.patience([7, 7, 7], [7, 7]) == [(0, 0), (1, 1)]
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 8) for _ in range(rng.randint(0, 12))] for _ in range(2))
        out = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in out)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(out))


def test_line_dedup(spark):
    line = lambda i, n=10: " ".join(f"w{i}x{j}" for j in range(n))
    block = "\n".join(line(i) for i in range(3))
    rows = [
        (1, f"{line(50)}\n{block}\n{line(51)}", "en", "a"),
        (2, f"{line(60)}\n{block}\n{line(61)}", "en", "a"),  # shares a block
        (3, f"{line(50)}\n{block}\n{line(51)}", "en", "a"),  # a copy
        (4, f"{line(70)}\nshort line\n{line(71)}", "en", "a"),
        (5, f"{line(80)}\nshort line\n{line(81)}", "en", "a"),  # shares a short line only
        (6, None, "en", "a"), (7, "", "en", "a"), (8, "", "en", "a"),
        (9, line(90), "en", "a"), (9, line(90), "en", "a"),  # repeated rows are one document
        (None, line(90), "en", "a"),
    ]
    out = linededup.dedup_lines(frame(spark, rows))
    assert out.columns == [c for c in SCHEMA.replace(",", "").split() if c not in ("long", "string")] + ["__lines", "__removed"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["text"], r["__removed"]))
    assert got[1] == [(rows[0][1], 0)]
    assert got[2] == [(f"{line(60)}\n{line(61)}", 3)]
    assert got[3] == [("", 5)]
    assert got[4] == [(rows[3][1], 0)] and got[5] == [(rows[4][1], 0)]
    assert got[6] == [(None, 0)] and got[7] == [("", 0)] and got[8] == [("", 0)]
    assert got[9] == [(line(90), 0)] * 2 and got[None] == [("", 1)]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def runs_held(earlier, later, words, least):
    """Brute force: lines of ``later`` in a run of ``least`` words that one of ``earlier`` holds."""
    out = set()
    for i, j in itertools.combinations(range(len(later) + 1), 2):
        run = later[i:j]
        if sum(words[x] for x in run) >= least and any(run == a[k : k + j - i] for a in earlier for k in range(len(a))):
            out |= set(range(i, j))
    return out


def test_common_lines_against_brute_force():
    x, y = 1, 2
    assert linededup.common_lines([x, 7], [8, x, 9, x], [1, 9, 1, 9], 8) == [1, 3]  # the later document repeats
    assert linededup.common_lines([x, 7, x], [8, x, 9], [1, 9, 1], 8) == [1]  # the first holder repeats
    assert linededup.common_lines([x, 7, y], [y, 8, x], [9, 1, 9], 8) == [0, 2]  # in another order
    rng = random.Random(1)
    for _ in range(500):
        words = [rng.choice([0, 1, 3, 5, 9]) for _ in range(6)]
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 10))] for _ in range(2))
        assert set(linededup.common_lines(a, b, [words[x] for x in b], 8)) == runs_held([a], b, words, 8)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["", *(" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate([1, 2, 3, 3, 5, 5, 7, 9, 12]))]
    words = {x: size_of(x) for x in vocabulary}
    docs = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    long, short = vocabulary[-1], vocabulary[1]
    docs += [["p", long, "q"], ["r", short, long, "s"], ["t", short, long, "u"]]  # the long line's first holder lacks the run
    docs += [["v", *vocabulary[2:5], "x"], ["y", *vocabulary[2:5], "z"]]  # short lines only
    words |= dict.fromkeys("pqrstuvxyz", 1)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, [(i, "\n".join(d), "en", "a") for i, d in enumerate(docs)])).collect()}
    for i, d in enumerate(docs):
        gone = runs_held(docs[:i], d, words, linededup.BLOCK_WORDS)
        assert got[i] == "\n".join(x for j, x in enumerate(d) if j not in gone)


def test_line_dedup_of_poems(spark, monkeypatch):
    """Lines of fewer words than a block: copies go in full, and a hot first holder's partners go by chunks."""
    monkeypatch.setattr(linededup, "CHUNK", 3)
    poem = "\n".join(" ".join(f"w{i}x{j}" for j in range(7)) for i in range(50))
    rows = [(i, poem, "en", "a") for i in range(9)] + [(20, "own words here\n" + poem[: poem.index("w30x0")] + "own end", "en", "a")]
    got = {r["doc_id"]: (r["text"], r["__removed"]) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: (poem, 0)} | {i: ("", 50) for i in range(1, 9)} | {20: ("own words here\nown end", 30)}


def test_line_dedup_of_clashing_columns(spark):
    line = " ".join(f"w{i}" for i in range(12))
    names = ["__lines", "__removed", "__cut", "__gone", "__id", "__h", "c0", "cut", "lines", "id", "h", "a.b"]
    docs = spark.createDataFrame([(i, f"x{i}\n{line}", *names) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert out[2]["text"] == "x2" and out[2]["__removed"] == 1 and out[1]["__lines"] == 2
    assert all(out[2][c] == c for c in names if c not in ("__lines", "__removed"))
    kept = corpus_pipeline.lines(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(names)}
    assert corpus_pipeline.near_duplicates(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1


def test_lines_are_compared_by_two_hashes():
    a, b = np.array([[1, 5], [2, 6], [3, 7]]), np.array([[2, 6], [1, 4], [3, 7]])
    x, y = linededup.numbers(a, b)
    assert x[1] == y[0] and x[2] == y[2] and x[0] != y[1] and len({*x, *y}) == 4
    assert linededup.numbers(a[:0], b[:0]) == ([], [])
    lines, marks, _, _ = textbytes.line_spans(*textbytes.buffers(pa.array(["\n".join(f"line {i % 700}" for i in range(2000))])))
    assert len(set(lines.tolist())) == len(set(marks.tolist())) == 700 and not set(lines.tolist()) & set(marks.tolist())


def test_line_dedup_of_scripts_without_spaces(spark):
    for passage in ("床前明月光疑是地上霜", "いろはにほへとちりぬるを", "กขฃคฅฆงจฉช", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇", "床前明月\n光疑是地\n上霜"):
        rows = [(1, f"a\n{passage}\nb", "zh", "a"), (2, f"c\n{passage}\nd", "zh", "a")]
        got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, rows)).collect()}
        assert got == {1: rows[0][1], 2: "c\nd"}
    texts = ["one two 三四五 é", "한국어 한국어", "東京x\n\nab", ""]
    data, offsets = textbytes.buffers(pa.array(texts))
    assert textbytes.line_spans(data, offsets)[2].tolist() == [6, 2, 2, 0, 1, 0]


# -- classifiers


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", "a"))
        labels.append((i, int(good)))
    rows += [(900, None, "en", "a"), (901, "", None, None), (None, "alpha beta", "en", "a"), (902, "alpha " * 50_000, "en", "a")]
    labels += [(5, None), (None, 1), (77777, 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, marks)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(x for x in labels if x[1] is not None)
    tested = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 50 and all(r["predicted"] == truth[r["doc_id"]] for r in tested)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in out if r["doc_id"] is not None)
    one_class = quality.train(docs, marks.where("quality = 1"))
    assert {round(r["score"], 5) for r in quality.score(docs, one_class).collect()} == {1.0}
    nothing = quality.train(docs, marks.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_quality_score_recomputed(spark):
    """Scores against a plain recount of n-gram columns and sums; the sample is bounded in rows and bytes, whoever holds them."""
    rows = [(i, f"Word{i % 7} and {'good' if i % 2 else 'BAD!!'} text {i}", "en", "a") for i in range(120)]
    rows += [(1, f"many rows of one id {i}", "en", "a") for i in range(400)] + [(3, "the same row", "en", "a")] * 400
    docs, marks = frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(120)] * 2, "doc_id long, quality int")
    model = quality.train(docs, marks, sample=100, sample_bytes=3000)
    assert np.count_nonzero(model.ratios != np.median(model.ratios)) < 3000
    again = quality.train(docs, marks, sample=100, sample_bytes=3000)
    assert (model.weights == again.weights).all() and model.shift == again.shift
    for r in quality.score(docs, model).limit(40).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        if r["doc_id"] in (1, 3):
            continue
        (cols,) = quality.ngrams(*textbytes.buffers(pa.array([text])))
        length = sum(float(model.ratios[c]) ** 2 for c in cols) ** 0.5
        margin = model.bias + sum(float(model.weights[c]) for c in cols) / length
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-5


def test_dual_coordinate_descent_solves_the_primal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows = [(np.arange(5, dtype=np.uint32), v) for v in x]
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(60), 300)
    sign = np.where(y > 0, 1, -1)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * (x @ w + b)).sum()
    best = loss(w[:5], b)
    for _ in range(300):
        assert best <= loss(w[:5] + rng.normal(0, 0.05, 5), b + rng.normal(0, 0.05)) + 1e-3


def test_language(spark):
    rng = random.Random(2)
    sounds = {"aa": ["bla", "blo", "bli", "stra"], "zz": ["kwe", "kwo", "xen", "yzz"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(rng.randint(5, 80))), lang, "a") for i in range(300) for lang in [rng.choice(["aa", "zz"])]]
    more = [(900, None, "aa", "a"), (901, "", "aa", "a"), (902, "123 ... !", None, "a"), (903, "東京", None, "a"), (904, "blablo " * 30_000, None, "a"), (None, "kwekwo xen", None, "a"), (905, "k", "zz", "a")]
    docs = frame(spark, rows + more)
    net = langid.train(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    assert len(out) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in out.values())
    tested = [r for r in rows if held_out(r[0])]
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in tested]) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["lang_pred"] != "und" and out[904]["lang_pred"] == "aa"
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0
    assert langid.train(docs.where("lang = 'none'")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(frame(spark, []), net).count() == 0


def test_network_against_plain_loops():
    """Probabilities against loops over filters and places."""
    rng = np.random.default_rng(3)
    windows = rng.integers(97, 105, (480, langid.LENGTH)).astype(np.uint8)
    lang = np.arange(480) % 2
    windows[lang == 1, 10:200:3] = 120
    net = langid.fit(windows, lang, ["a", "b"])
    p = net.probabilities(windows)
    filters = langid.FILTERS * len(langid.WIDTHS)
    for i in range(3):
        x = net.embed[windows[i]]
        top = []
        for f in range(filters):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = net.kernel[:, f].reshape(-1, langid.DIM)[:width]
            top.append(max(float((x[j : j + width] * kernel).sum()) for j in range(langid.LENGTH - langid._WIDE + 1)))
        hidden = np.maximum(np.array(top) + net.bias, 0)
        z = np.exp(hidden @ net.out + net.out_bias)
        assert np.allclose(p[i], z / z.sum(), atol=1e-4)
    assert (p.argmax(axis=1) == lang).mean() > 0.9


def test_language_sample_is_bounded(spark):
    """One row repeated very often, or rows without id, neither fill the sample nor hide the rest."""
    rows = [(None, f"bla blo {i}", "aa", "a") for i in range(1500)] + [(1, "kwe kwo xen", "zz", "a")] * 1500 + [(i, f"kwo yzz {i}", "zz", "a") for i in range(2, 300)]
    docs = frame(spark, rows)
    net = langid.train(docs, per_lang=200)
    out = langid.identify(docs, net).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"] for r in out} == {"aa", "zz"}


def test_windows_cover_every_byte():
    texts = [b"", b"a", b"x" * 255, b"y" * 256, b"z" * 257, bytes(range(250)) * 7]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows, first, used = langid.windows_of(data, at)
    for i, t in enumerate(texts):
        own = windows[first[i] : first[i + 1]]
        assert b"".join(w[:u].tobytes() for w, u in zip(own[:-1], used[first[i] : first[i + 1] - 1], strict=True)) + own[-1].tobytes()[: len(t) - (len(own) - 1) * langid._STRIDE] == t
        assert len(own) * langid._STRIDE + langid._WIDE - 1 >= len(t)


@pytest.mark.parametrize("name", ["near_duplicates", "lines", "mix", "pack"])
def test_scratch_is_empty_after_a_stage(spark, tmp_path, name):
    """What a stage writes in between goes when it is done; at the end of a scope nothing is left."""
    where = scratch.scratch_dir(spark).removeprefix("file://") + "/siltstone"
    tables = lambda: set(os.listdir(where)) if os.path.isdir(where) else set()
    before = tables()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with scratch.scope():
        out = getattr(corpus_pipeline, name)(spark, docs, "/root/testdata/sf0.001")
        assert len(tables() - before) <= 4
        out.write.parquet(f"{tmp_path}/out")
    assert tables() == before

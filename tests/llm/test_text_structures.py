"""Phrase fingerprints, the prefix trie and spelling variants against plain versions, on small and odd tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmart.llm import phrase_fingerprints as pf
from regmart.llm import prefix_trie, spelling_variants

DOCS = "doc_id long, text string, at long, tie long, part int, ahead boolean, word string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, True, "clash", 1) for i, t in rows], DOCS).repartition(3)


def odd_rows(seed=0):
    rng = np.random.default_rng(seed)
    long = " ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(3, 12)))) for _ in range(20_000))
    return [(1, None), (2, ""), (None, "Ab c Ünïcode"), (3, "a b c"), (3, "a b c"), (3, "other"), (4, long), (5, " \n\t "), (None, None), (-7, "𝄞x𝄞x𝄞x𝄞x")]


# ---- 11


def plain_phrases(text):
    """Letter by letter: a phrase ends where it has not been one before."""
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaaaaaaaa", "abababababababc", "the cat the hat the bat", "é𝄞é𝄞é𝄞é𝄞é"])
def test_phrases(text):
    seen = set()
    ends = pf.phrases(text, seen)
    assert seen == plain_phrases(text) and len(ends) == len(seen)
    assert len(set(pf.phrase_hashes(text, ends).tolist())) == len(seen)


def test_phrases_of_random_texts_and_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé "), int(rng.integers(1, 900)))) for _ in range(60)]
    whole = []
    for t in texts:
        seen = set()
        ends = pf.phrases(t, seen)
        assert seen == plain_phrases(t)
        whole.append(pf.phrase_hashes(t, ends))
    monkeypatch.setattr(pf, "_PIECE", 7)
    for t, h in zip(texts, whole):
        assert np.array_equal(pf.phrase_hashes(t, pf.phrases(t, set())), h)


def test_hashes_depend_on_the_phrase_alone():
    a, b = set(), set()
    ends_a, ends_b = pf.phrases("xyzzy hello", a), pf.phrases("hello xyzzy", b)
    ha = dict(zip(("xyzzy hello"[i:j] for i, j in zip([0, *ends_a], ends_a)), pf.phrase_hashes("xyzzy hello", ends_a).tolist()))
    hb = dict(zip(("hello xyzzy"[i:j] for i, j in zip([0, *ends_b], ends_b)), pf.phrase_hashes("hello xyzzy", ends_b).tolist()))
    assert all(ha[p] == hb[p] for p in set(ha) & set(hb)) and set(ha) & set(hb)


def test_likeness_estimates_the_share_of_common_phrases():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), 5)) for _ in range(300)]
    errors = []
    for _ in range(25):
        a = " ".join(rng.choice(vocabulary, 600))
        b = a[: int(rng.integers(0, len(a)))] + " ".join(rng.choice(vocabulary, 300))
        x, y = plain_phrases(a), plain_phrases(b)
        errors.append(pf.likeness(pf.fingerprint(a), pf.fingerprint(b)) - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.17 and abs(np.mean(errors)) < 0.03
    assert pf.likeness(pf.fingerprint(""), pf.fingerprint("")) == 1.0 and pf.likeness(pf.fingerprint(""), pf.fingerprint("a")) == 0.0
    short = pf.likeness(pf.fingerprint("the cat sat"), pf.fingerprint("the cat ran"))
    x, y = plain_phrases("the cat sat"), plain_phrases("the cat ran")
    assert short == len(x & y) / len(x | y)


def plain_neighbours(rows):
    """Rows in order, each with its next one. Rows of one id are ordered by what the caller found them to be."""
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        own, other, after = (pf.fingerprint(t) for t in (text, edited, following))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), pf.as_text(own), pf.as_text(other), pf.likeness(own, other), pf.likeness(own, after)))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["odd", "many", "one", "empty"])
def test_neighbours(spark, case, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {
        "odd": odd_rows(),
        "many": [(int(i), " ".join(rng.choice(["ab", "abc", "dd", "é"], int(rng.integers(0, 60))))) for i in rng.permutation(400)] + [(7, "same id")] * 90,
        "one": [(5, "only one document")],
        "empty": [],
    }[case]
    if case == "many":
        monkeypatch.setattr(pf, "TASK_BYTES", 500)
    given = docs_of(spark, rows)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    order = [(r[0], r[1] or "") for r in given.orderBy(F.col("doc_id").asc_nulls_first(), tie).select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in pf.compare_neighbours(given).collect()), key=str)
    assert got == plain_neighbours(order)


# ---- 12


def plain_nodes(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(p)))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            code = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), code, (role or "", text or "")))
    own = {c: tuple(t for _, _, t in sorted(ts)) for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, ())[:h] + turns[h:]
    return out


@pytest.mark.parametrize("block", [3, 40, 10**6])
def test_prefix_nodes(spark, block):
    """A third of all conversations are equal, so in small blocks most prefixes reach over several."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(160):
        same = c % 3 == 0
        for turn in range(4 if same else int(rng.integers(0, 9))):
            text = f"t{turn}" if same else "x" * int(rng.integers(3))
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(300, None, None, None), (300, 2, None, "b"), (300, 2, "a", None), (300, 2, "a", None), (None, 1, "user", "no conversation"), (401, 0, "user", "y")]
    rows += [(500, t, "user", f"long {t}") for t in range(3000)]
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, turns int")
    convs = prefix_trie.with_family_heads(prefix_trie.sequences(given.repartition(4)))
    got = prefix_trie.prefix_nodes(convs, block).select(NODE).collect()
    expected = plain_rebuilt(rows)
    if block == 3:  # the plain version is quadratic in turns
        assert len(got) == len({t[:d] for t in expected.values() for d in range(len(t) + 1)})
        got = [r for r in got if r.depth < 12 and r.depth > 0]
        expected = {c: t[:12] if len(t) > 100 else t for c, t in expected.items()}
        assert sorted((tuple(r)[:5] for r in got if r.depth < 11), key=str) == sorted((r[:5] for r in plain_nodes(expected) if 0 < r[1] < 11), key=str)
        return
    short = given.filter("conv_id <> 500")
    got = prefix_trie.prefix_nodes(prefix_trie.with_family_heads(prefix_trie.sequences(short)), block).select(NODE).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(plain_rebuilt([r for r in rows if r[0] != 500]))


def test_prefix_nodes_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(prefix_trie.with_family_heads(prefix_trie.sequences(none))).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "a")], none.schema)
    assert prefix_trie.prefix_nodes(prefix_trie.sequences(lost)).collect() == []
    bare = spark.createDataFrame([(9, 0, "user", "abc")], none.schema).select("conv_id", F.slice(F.array(F.struct(F.lit("0" * 32).alias("code"), F.lit(3).alias("size"))), 1, 0).alias("turns"))
    assert [tuple(r) for r in prefix_trie.prefix_nodes(bare).select(NODE).collect()] == [(9, 0, None, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())]


def test_range_minima():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 5, 37)
    table = prefix_trie.RangeMinimum(values)
    first = rng.integers(0, 37, 200)
    last = np.array([rng.integers(a, 37) for a in first])
    assert table.of(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
    least = rng.integers(0, 6, 200)
    right = [next((j - 1 for j in range(a + 1, 37) if values[j] < x), 36) for a, x in zip(first, least)]
    left = [next((j for j in range(a, 0, -1) if values[j] < x), 0) for a, x in zip(first, least)]
    assert table.reach_right(first, least).tolist() == right
    assert table.reach_left(first, least).tolist() == left


# ---- 13


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts, factor=10):
    best, n_near = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        n_near[w] = len(others)
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        best[w] = top if top is not None and counts[top] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.append((w, best[w], root, n, n_near[w], counts.get(best[w])))
    return sorted(out)


def variants(spark, counts, **options):
    rows = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, form string")
    return sorted(tuple(r) for r in spelling_variants.spelling_variants(rows, **options).collect())


@pytest.mark.parametrize("shape", ["short", "dense", "chains"])
def test_variants(spark, shape):
    rng = np.random.default_rng(7)
    if shape == "short":  # all kinds of short words, also of one letter
        words = ["".join(w) for k in (1, 2, 3, 4) for w in itertools.product("abé", repeat=k) if rng.random() < 0.5]
    elif shape == "dense":
        words = ["".join(rng.choice(list("aab"), int(rng.integers(7, 11)))) for _ in range(250)]
    else:
        words = [w for stem in ("spelling", "variants", "frontier") for i in range(1, 9) for w in (stem[:-1] + "x" * i, stem + "x" * i)]
    counts = {w: int(10 ** rng.integers(0, 7)) for w in set(words)}
    assert [r[:6] for r in variants(spark, counts)] == plain_variants(counts)


def test_long_words(spark):
    rng = np.random.default_rng(8)
    stem = "".join(rng.choice(list("abcé"), 300))
    words = [stem, stem[:150] + "z" + stem[151:], stem[:299], stem[1:], stem + "q", "a" * 63, "a" * 64, "a" * 65, "a" * 66, "a" * 64 + "b", "b" + "a" * 63, "ab" * 40]
    counts = {w: int(10 ** rng.integers(0, 4)) for w in words}
    assert variants(spark, counts) == plain_variants(counts)
    long = "".join(rng.choice(list("abcd"), 40_000))
    counts = {long: 50, long[:20_000] + long[20_001:]: 2, long[:-1] + "z": 3}
    got = variants(spark, counts)
    assert sorted(r[4] for r in got) == [1, 1, 2] and {r[2] for r in got} == {long}


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants.spelling_variants(none).collect() == []
    one = spark.createDataFrame([("lonesome", 3), (None, 5), ("", 9)], "word string, n long")
    assert [tuple(r) for r in spelling_variants.spelling_variants(one).collect()] == [("lonesome", None, "lonesome", 3, 0, None)]
    assert spelling_variants.corpus_words(spark.createDataFrame([], DOCS)).collect() == []


def test_corpus_words(spark):
    rows = odd_rows() + [(i, "Wörterbuch WÖRTERBUCH ÀÇÉ×÷ÿxx spelling Spelling spelled1spelled a-longest_longest " + "x" * 7 + " " + "y" * 6) for i in range(70)]
    expected = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            expected[run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}
    got = spelling_variants.corpus_words(docs_of(spark, rows))
    assert {r.word: r.n for r in got.collect()} == expected

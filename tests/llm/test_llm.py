"""The training-data operators on small tables: brute force, round trips, planted cases and odd rows."""

import collections
import hashlib
import math
import re
import string
import sys
import time
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import regmart.llm as llm
from checks.compare import compare, connect
from regmart.llm import (
    bag_minhash, decontamination, exact_dedup, gru_lm, html_extraction, mixing, site_quality, token_files, toxicity, warc,
)

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, bucket long, salt int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 1, 1) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white-space texts, a very long one, repeated rows and ids, clashing column names."""
    long = words(np.random.default_rng(0), 30_000, 5000)
    return docs_of(spark, [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (3, "other"), (4, long), (5, " \n\t "), (None, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_same_rows_as_sql(spark, name):
    with connect(SF) as con:
        assert compare(llm.QUERIES[name](spark, SF), con, llm.ORACLE[name]) == []


# ---- 7


def naive_groups(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    key = lambda x: (x is not None, x or 0)
    out = []
    for t, ids in by.items():
        keep = max(ids, key=key)
        seen = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen = seen or i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, weak):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(30)), str(rng.choice(["x", "xy", "y", "", "z" * 50]))) for _ in range(200)] + [(r.doc_id, r.text) for r in odd.collect()]
    digest = (lambda t: F.substring(F.concat(t, F.lit("-")), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_groups(docs_of(spark, rows), digest=digest)
    width = 4 if weak else 5  # a weak digest is what comes out as the last column
    assert sorted((tuple(r)[:width] for r in got.collect()), key=str) == sorted((r[:width] for r in naive_groups(rows)), key=str)


# ---- 2


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    rng = np.random.default_rng(1)
    signs = list("aAbBéÉ.,'&|< >\n\t0123½İ日🙂st́")
    texts = ["", " a ", "<|endoftext|> x", "don't DON'T 's", "a\x0bb\x0cc\x1cd"] + ["".join(rng.choice(signs, rng.integers(40))) for _ in range(800)]
    ids, sizes = token_files.PieceEncoder(token_files.tokenizer_path()).encode(pa.array(texts, pa.large_string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_that_are_not_composed():
    """All letters that the tokenizer's composed form (NFC) changes, before each sign, alone and after another letter."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    letters = [c for c in letters if c.isalpha() and unicodedata.normalize("NFC", c) != c]
    assert len(letters) > 1000
    common = [c for c in letters if ord(c) < 0x20000 and len(unicodedata.normalize("NFC", c)) > 1]
    signs = token_files.PieceEncoder._SIGNS
    texts = [f"{a}{c}{sign}" for c in common for sign in signs for a in ("", "x", "\u09b9")] + [f"{c}{sign}" for c in letters for sign in ",)"]
    encoder = token_files.PieceEncoder(token_files.tokenizer_path())
    ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_forgotten(monkeypatch):
    encoder = token_files.PieceEncoder(token_files.tokenizer_path())
    monkeypatch.setattr(token_files, "_MAX_LETTERS", 50)
    texts = pa.array(["some words, others", "some other words"], pa.large_string())
    first = encoder.encode(texts)
    for _ in range(5):
        encoder.encode(pa.array([f"number{i} of many" for i in range(40)], pa.large_string()))
        assert len(encoder.places) <= 60
    assert [x.tolist() for x in encoder.encode(texts)] == [x.tolist() for x in first]


def test_words_of_a_to_z_go_straight_to_the_model(monkeypatch):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list(string.ascii_lowercase), rng.integers(1, 20))) for _ in range(300)) for _ in range(20)]
    encoder = token_files.PieceEncoder(token_files.tokenizer_path())
    encoder.encode(pa.array([","], pa.large_string()))
    monkeypatch.setattr(encoder, "tokenizer", None)  # not asked
    ids, sizes = encoder.encode(pa.array([t.title() + "," if i % 2 else t for i, t in enumerate(texts)], pa.large_string()).slice(1))
    assert len(ids) == sizes.sum()
    encoder = token_files.PieceEncoder(token_files.tokenizer_path())
    ids, sizes = encoder.encode(pa.array(["x y", *texts], pa.large_string()).slice(1))
    whole = Tokenizer.from_file(token_files.tokenizer_path())
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_are_not_copied_by_place():
    """Known pieces are put together, and shards opened, without a 64-bit place for each id."""
    rng = np.random.default_rng(4)
    texts = pa.array([words(rng, 5000) for _ in range(40)], pa.large_string())
    encoder = token_files.PieceEncoder(token_files.tokenizer_path())
    ids, sizes = encoder.encode(texts)
    data = token_files.pack(ids, sizes.astype(np.uint32))
    steps = (lambda: encoder.encode(texts), lambda: list(token_files.Shard(data).documents()))
    for step in steps:
        tracemalloc.start()
        try:
            step()
            assert tracemalloc.get_traced_memory()[1] < 8 * len(ids)
        finally:
            tracemalloc.stop()


@pytest.mark.parametrize("n,places", [(10, [0, 3, 9]), (10, []), (0, []), (5000, [0, 1, 4999]), (5000, [2500])])
def test_without_some_places(n, places):
    x = np.arange(n)
    got = token_files._without([x, x % 2 == 0], np.array(places, np.int64))
    assert got[0].tolist() == np.delete(x, places).tolist() and got[1].tolist() == np.delete(x % 2 == 0, places).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_shards_open_anywhere(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.choice(50, rng.integers(0, 400), p=rng.dirichlet(np.ones(50) * 0.1)).astype(np.uint32) for _ in range(30)]
    docs.append(np.full(500, 7, np.uint32))
    shard = token_files.Shard(token_files.pack(docs, min_uses=3, rounds=8))
    assert len(shard.rules) > 0
    whole = np.concatenate(docs)
    for i, (a, b) in enumerate(zip(docs, shard.documents())):
        assert a.tolist() == b.tolist() == shard.document(i).tolist()
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert shard.tokens(int(a), int(b)).tolist() == whole[a:b].tolist()
    assert token_files.Shard(token_files.pack([])).n_tokens == 0


def test_replacement_goes_on_to_the_end():
    ids = np.tile(np.random.default_rng(15).integers(2, 30_000, 5000), 200).astype(np.uint32)
    data = token_files.pack(ids, np.full(200, 5000, np.uint32))
    shard = token_files.Shard(data)
    assert np.array_equal(shard.tokens(0, len(ids)), ids) and np.array_equal(shard.document(77), ids[:5000])
    assert shard.lengths.max() > 16 and len(data) < len(ids) / 8
    seq = token_files.re_pair(ids)[2]
    assert not len(token_files.pair_round(seq, np.ones(len(seq), bool), token_files.BASE + len(shard.rules), token_files.MIN_USES)[2])
    with pytest.raises(ValueError):
        token_files.Shard(b"xxxx" + bytes(16))


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(token_files.tokenizer_path()), 0
    shards = token_files.write_shards(odd, token_files.tokenizer_path(), shard_chars=40)
    got = sorted(token_files.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 3, 4, 5]
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    seen = collections.Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        fit = [k for k in texts if k[0] == r.doc_id and zlib.crc32(np.array(whole.encode(k[1], add_special_tokens=False).ids + [1], "<u4").tobytes()) == r.ids_crc32]
        seen[fit[0] if len(fit) == 1 else sorted(fit)[0]] += 1
    assert seen == texts
    some = token_files.read_tokens(shards, [4]).collect()
    assert [(r.doc_id, r.ids[-1]) for r in some] == [(4, 1)]
    assert token_files.read_shards(token_files.write_shards(empty, token_files.tokenizer_path())).count() == 0


# ---- 3


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("<nav><a href=x>menu</a></nav>", ""),
    ("<html><head><title>t</title><style>p{}</style></head><body><article><h1>A &amp; B</h1><p><b>one<br>two  three</article><footer>f</footer>", "A & B one two three"),
    ("<article><p>x</p><aside>no</aside><div class='comments'><p>reader</p></div><form><input>send</form><p>y&nbsp;z &lt;b&gt;</p></article>", "x y z <b>"),
    ("<div class='sidebar'>" + "side " * 40 + "</div><div><p>" + "text " * 40 + "</p></div><div id=cookie-notice>" + "ok " * 40 + "</div>", ("text " * 40).strip()),
    ("<ul><li><a href=a>" + "link " * 30 + "</a></li></ul><p>" + "body " * 30 + "</p>", ("body " * 30).strip()),
    ("<article>1 < 2 and 3 > 2<script>var x='</p>'</script> end<!-- no --></article>", "1 < 2 and 3 > 2 end"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
])
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


LONG, ITEMS = " ".join(f"body{i}" for i in range(60)), "".join(f"<li><a href=x>link {i}</a></li>" for i in range(6))


@pytest.mark.parametrize("page,text", [
    (f"<div><p>{LONG}</p></div><article class='teaser'><p>{'tease ' * 30}</p></article>", LONG),
    (f"<div><p>{LONG}</p></div><article id='comment-7'><p>{'said ' * 200}</p></article>", LONG),
    (f"<div><p>{LONG}</p></div><nav>m</nav><article><p>short tease</p></article>", LONG),
    (f"<article class='teaser'><p>{LONG}</p></article>", LONG),
    (f"<div><p>{'advert ' * 9}</p></div><nav>m</nav><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>see</p><ul>{ITEMS}</ul><p>end</p></article>", "see " + " ".join(f"link {i}" for i in range(6)) + " end"),
    (f"<article><p>see</p><ul>{ITEMS}</ul></article><ul>{ITEMS}</ul>", "see " + " ".join(f"link {i}" for i in range(6))),
])
def test_articles_are_evidence(page, text):
    assert html_extraction.main_text(page) == text


BODY = " ".join(f"body{i}" for i in range(90))


@pytest.mark.parametrize("page,text", [
    (f'<div class="content-with-sidebar"><article>{BODY}</article></div>', BODY),
    (f'<div class="page sidebar-right"><article>{BODY}</article><div class=sidebar>{"side " * 30}</div></div>', BODY),
    (f'<div class="search-results-page"><p>{BODY}</p></div><footer>f</footer>', BODY),
    (f'<div class="post comments-open"><article><h1>Title</h1>{BODY}</article></div>', f"Title {BODY}"),
    (f'<form id=all><nav>n</nav><div>{BODY}</div><button>send</button></form>', BODY),
    (f'<div style="overflow:hidden">{BODY}</div><div style="display: none">{BODY}</div><p hidden>{BODY}', BODY),
    (f'<div><p>{BODY}</p></div><div class=comments><article>{"said " * 400}</article></div>', BODY),
    (f'<article></article><div class=ad>{"buy " * 90}</div>', ""),
    ("<div><p>short one</p><p>two</p></div><footer>f</footer>", "short one two"),
    (f"<div><p>in short</p><div class=ad>ad</div><p>{BODY}</p><div class=ad>ad</div><p>the end</p></div><div>f</div>", f"in short {BODY} the end"),
    (f"<i><div>{BODY}</i> on</div>", f"{BODY} on"),
    ("<p title='a>b' x=\">\">in</p><b title=don't>quoted</b>", "in quoted"),
    ("<p>&#" + "1" * 5000 + "; &#" + "0" * 5000 + "65; &#x" + "0" * 5000 + "42;", "\ufffd A B"),
])
def test_marks_are_evidence(page, text):
    assert html_extraction.main_text(page) == text


def test_text_without_article_tags():
    """Lengths alone find what the tags tell: pages whose <article> is made a <div> give the same text."""
    pages = [x or "" for x in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()]
    same = [html_extraction.main_text(re.sub(r"(</?)article\b", r"\1div", x)) == html_extraction.main_text(x) for x in pages]
    assert sum(same) >= 0.95 * len(pages)


def plain_runs(size: list[int], window: int, surge: int) -> list[bool]:
    sums = [sum(size[i : i + window]) for i in range(len(size))]
    out = [False] * len(size)
    for i in range(len(size)):
        a = b = i
        while sums[i] and a and sums[a - 1]:
            a -= 1
        while sums[i] and b + 1 < len(size) and sums[b + 1]:
            b += 1
        out[i] = bool(sums[i]) and max(sums[a : b + 1]) >= min(surge, max(sums))
    return out


def test_surge_and_dive_against_plain_sums():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = rng.choice([0, 0, 0, 1, 9, 30, 80], int(rng.integers(0, 30)))
        window, surge = int(rng.integers(1, 5)), int(rng.integers(1, 90))
        assert html_extraction._surging(size.astype(np.int64), window, surge).tolist() == plain_runs(size.tolist(), window, surge)


@pytest.mark.parametrize("page", [
    "<a " * 300_000, "<a " * 300_000 + ">", "<b>" * 150_000 + "</i>" * 150_000, "<" + "a" * 1_000_000, "<a x=\">\" " * 100_000,
    "<i><div>" + "<b>" * 120_000 + "</i>" * 120_000, "<div class=ad>x" * 60_000, "<!--" * 200_000, "&#" * 400_000,
], ids=range(9))
def test_odd_markup_takes_linear_time(page):
    begun = time.process_time()
    html_extraction.main_text(page)
    assert time.process_time() - begun < 10  # some 2 seconds; squared, many minutes


def test_extract_odd_pages(spark):
    rows = [(1, None, None), (None, "u", "<article>a</article>"), (2, "u", "<article>" + "x " * 50_000 + "</article>"), (2, "u", "")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 1, 99_999]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 8


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    data = warc.version_block(version, "n.arc", "2024")
    bodies = [b"", b"a\nb", b"HTTP/1.1 200 OK\r\n\r\nx" * 3]
    for i, body in enumerate(bodies):
        data += warc.arc_header(version, f"http://a b/{i}", "1.2.3.4", "20240229", "text/html", len(body), len(data)) + body + b"\n"
    got = list(warc.read_arc(data))
    assert [r["content"] for r in got] == bodies and got[0]["URL"] == "http://a%20b/0" and got[0]["version"] == version
    assert warc.warc_date(got[0]["Archive-date"]) == "2024-02-29T00:00:00Z"
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(data[:-8]))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(data + b"http://x 1 2\n"))


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    html = "é" * 60
    rows = [(3, "u", html), (1, "v", html), (2, None, html), (4, "w", "short"), (5, "w", "short"), (6, None, None), (7, "z", "x" * 300_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in warc.op8_arc_to_warc(spark, str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None),
    }
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())


def test_archives_of_null_ids_clashing_names_and_no_rows(spark, tmp_path):
    long, lone = "p" * 200, "q" * 200
    rows = [(None, None, long, 1, "r"), (5, "u", long, 2, "r"), (9, "u", long, 3, None), (None, "u", lone, 4, "r"), (None, "v", lone, 5, "r"), (None, None, None, 6, "r")]
    schema = "page_id long, url string, html string, part int, record_type string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "odd/pages.parquet"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op8_arc_to_warc(spark, str(tmp_path / "odd")).collect())
    assert got == collections.Counter([
        (5, 200, "response", None), (9, 200, "revisit", 5), (None, 200, "revisit", 5), (None, 200, "response", None), (None, 200, "revisit", None),
        (None, 0, "response", None),
    ])
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert warc.op8_arc_to_warc(spark, str(tmp_path / "none")).count() == 0


def test_malformed_members(spark):
    body, date = b"HTTP/1.1 200 OK\r\n\r\nx", "20240101"
    good = warc.version_block(1, "n", date) + 2 * (warc.arc_header(1, "http://a", "1.2.3.4", date, "text/html", len(body)) + body + b"\n")
    bad = [b"no end", b"http://a 1.2.3.4 2024 text/html x\n", b"http://a 1.2.3.4 2024 text/html 99\nshort", b"http://a 1 2 3 4 5 6\n", b"http://\xff 1.2.3.4 2024 t 0\n", b"http://a 1.2.3.4 soon t 0\n"]
    members = [good, *(good + x for x in bad), b"", b"junk\n", b"filedesc://n 0.0.0.0 2024 text/plain 3\n9 x\n"]
    arc = spark.createDataFrame([(0, i, bytearray(x)) for i, x in enumerate(members)], "part int, member int, data binary")
    assert {r.member: r["count"] for r in warc.arc_records(arc, strict=False).groupBy("member").count().collect()} == dict.fromkeys(range(7), 2)
    broken = {r.member: (r.offset, r.n_records) for r in warc.arc_errors(arc).collect()}
    assert broken == {i: (len(good), 2) for i in range(1, 7)} | {8: (0, 0), 9: (0, 0)}
    assert warc.read_records(warc.convert(arc, ["uri"], strict=False)).count() == 14
    with pytest.raises(Exception, match="ArcError"):
        warc.arc_records(arc).count()


# ---- 9


def naive_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then those left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    shift = lambda k, found: [(s, a + k, b + k) for s, a, b in found]
    return naive_segments(scores[:i]) + [(best[0], i, j - 1)] + shift(j, naive_segments(scores[j:]))


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = [int(rng.integers(1, 9)) if rng.random() < 0.4 else -3 for _ in range(rng.integers(0, 14))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -3)
        assert sorted(round(s, 6) for s, _, _ in got) == sorted(s for s, _, _ in naive_segments(scores))
        assert all(s == sum(scores[a : b + 1]) for s, a, b in got)


def test_words_of_all_scripts():
    assert toxicity.words_of("Ein Wort, dann 2 x_y") == ["ein", "wort", "dann", "2", "x_y"]
    assert toxicity.words_of("ab毒毒品c 好") == ["ab", "毒毒", "毒品", "c", "好"]
    assert toxicity.words_of("x" * 150) == ["x" * 64, "x" * 64, "x" * 22]
    for text in ("plain words here", "ab毒毒品c 好, ไทยคำ", "y" * 70 + " 中"):
        assert [text[a:b] for a, b in toxicity.spans_of(text)] == toxicity.words_of(text)


def test_toxic_terms_within_runs_and_long_words(spark):
    """Terms in the middle of runs without spaces, and at the end of very long words, are learned and found."""
    rng = np.random.default_rng(21)
    run = lambda n: "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, n))
    rows, told = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, run(60) + ("毒狗" if toxic else "") + run(60) if i % 2 else words(rng, 40) + " " + "q" * 64 + ("vilescum" if toxic else "nicewords")))
        told.append((i, int(toxic)))
    # toxic documents stand on even places only, so half of them are moved to runs
    rows = [(i, run(60) + "毒狗" + run(60)) if i % 8 == 0 else (i, t) for i, t in rows]
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(told, "doc_id long, toxic int"), None)
    assert {"毒狗", "vilescum"} <= set(model.forms)
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(docs_of(spark, rows), model).collect()}
    assert found == dict(told)


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    rng = np.random.default_rng(2)
    train = docs_of(spark, [(i, words(rng, 60) + (" vile scum" if i % 3 == 0 else "")) for i in range(300)])
    told = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, told)
    scored = toxicity.score_documents(odd, model)
    assert scored.count() == 9 and scored.filter("score is null or predicted = 1").count() == 0
    found = toxicity.passages(docs_of(spark, [(9, words(rng, 200) + " Scum, vile scum " + words(rng, 100))]), model).collect()
    assert [(r.first_word, r.last_word, r.passage) for r in found] == [(200, 202, "scum, vile scum")]
    none = toxicity.fit(empty, told)
    assert none.forms == {} and toxicity.score_documents(empty, none).count() == 0


# ---- 6


def bag_of(text):
    w = [x for x in (p.strip(string.punctuation) for p in text.lower().split()) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_signatures_estimate_weighted_jaccard():
    rng, off = np.random.default_rng(1), []
    for _ in range(30):
        a = rng.integers(0, 20, 60)
        b = np.where(rng.random(60) < 0.7, a, rng.integers(0, 20, 60))
        e = rng.integers(0, 2**62, 60).astype(np.uint64)
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = bag_minhash.signatures(doc, np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 1000)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03


def test_components(spark):
    """Against label propagation: a chain, a star, a ring, random links, a loop, and links found later."""
    rng = np.random.default_rng(3)
    first = [(i, i + 1) for i in range(100, 160)] + [(299, i) for i in range(200, 240)] + [(i, 300 + (i + 7) % 20) for i in range(300, 320)]
    first += [tuple(int(x) for x in rng.integers(400, 600, 2)) for _ in range(90)] + [(700, 700), (100, 101)]
    later = [(160, 239), (805, 800), (320, 450), (801, 800)]

    def expected(links):
        label = {v: v for link in links for v in link}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = bag_minhash.components(links(first))
    assert dict(found.collect()) == expected(first)
    assert dict(bag_minhash.extended(found, links(later)).collect()) == expected(first + later)
    assert bag_minhash.extended(found, links([])).exceptAll(found).isEmpty()
    assert bag_minhash.components(links([])).count() == 0


def test_classes_of_near_copies(spark, odd, empty):
    rng, rows = np.random.default_rng(4), []
    for i in range(60):
        base = words(rng, int(rng.integers(3, 120))).split()
        for k in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = "new" + str(rng.integers(9))
            rows.append((i * 10 + k, " ".join(copy)))
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    bags = [bag_of(t or "") or collections.Counter({t or "": 1}) for _, t in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                parent[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    expected = sorted((str(i), len(m)) for m in members.values() for i in m)
    got = bag_minhash.classes(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.class_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(members)
    kept = bag_minhash.drop_near_copies(docs_of(spark, rows))
    assert kept.columns == odd.columns and kept.count() == len(members)
    assert bag_minhash.classes(empty).count() == 0


# ---- 5


def naive_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(6)
    pairs = [(rng.integers(0, 4, rng.integers(0, 20)), rng.integers(0, 4, rng.integers(0, 12))) for _ in range(60)]
    assert decontamination.align([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [naive_align(a, b) for a, b in pairs]


def test_leaks(spark, odd, empty):
    rng = np.random.default_rng(8)
    items = [(i, words(rng, 30, 3000)) for i in range(20)] + [(20, None), (21, ""), (3, None), (None, "x y z")]
    edited = items[4][1].split()
    for k in (3, 11, 12, 22):
        edited[k] = "changed"
    del edited[17]
    rows = [(100 + i, words(rng, 200, 3000)) for i in range(40)]
    rows += [(1, f"{words(rng, 50, 3000)} {items[3][1].upper()}. {words(rng, 50, 3000)}"), (2, f"{words(rng, 9, 3000)} {' '.join(edited)}")]
    rows += [(3, items[5][1]), (3, items[5][1])] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 3), (2, 4), (3, 5)}
    kept = decontamination.drop_leaks(docs_of(spark, rows), bench)
    assert kept.columns == odd.columns and kept.count() == len(rows) - 4
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0


def test_copies_without_the_rare_words_leak(spark):
    """Copies whose rarer third of words, more or less, is replaced, against alignment by brute force."""
    rng = np.random.default_rng(14)
    documents, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r.text or "" for r in documents.select("text").collect()]
    own = lambda text: [w for x in text.lower().split() if (w := x.strip(decontamination._SIGNS))]
    counts = collections.Counter(w for t in texts for w in own(t))
    copies, expected = [], set()
    for r in bench.collect():
        item = own(r.text)
        number = {w: i for i, w in enumerate(item)}
        rarity = np.log([max(counts[w], 0.5) for w in item])
        for k in range(5):
            copy = list(item)
            for at in np.argsort(rarity + rng.normal(0, float(k > 0), len(item)))[: round(len(item) / 3)]:
                copy[at] = f"new{at}word"
            best = decontamination.align([np.array([number.get(w, -2) for w in copy])], [np.array([number[w] for w in item])])[0]
            held = {tuple(item[i : i + 3]) for i in range(len(item) - 2)} & {tuple(copy[i : i + 3]) for i in range(len(copy) - 2)}
            copies.append((10**9 + len(copies), " ".join(copy)))
            if held and best >= min(max(len(item), 2 * min(8, len(item))), 26):
                expected.add((copies[-1][0], r.item_id))
    table = documents.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string").repartition(2))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, bench).filter(F.col("doc_id") >= 10**9).collect()}
    assert len(expected) > 900 and len(expected - got) <= len(expected) // 500


# ---- 4


def test_site_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in site_quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, 50) if i % 10 < (9 if i < 300 else 1) else "$$$ %%% " * 20) for i in range(600)] + [(1000, "w1 w2"), (2000, "w1 w2")]
    table = docs_of(spark, rows).withColumn("host", F.when((F.col("doc_id") < 300) | (F.col("doc_id") == 1000), "good").otherwise("bad"))
    told = spark.createDataFrame([(i, int(t[0] == "w")) for i, t in rows[:600]], "doc_id long, quality int")
    rates = {r.doc_id: r for r in site_quality.classify(table, told, F.col("host"), F.col("lang")).collect()}
    assert rates[1000].path_rate > 0.7 > 0.4 > rates[2000].path_rate and rates[1000].score > rates[2000].score
    assert site_quality.classify(odd, told, F.col("source"), F.lit(None)).filter("score is not null").count() == 9
    assert site_quality.classify(empty, told, F.col("source"), F.col("lang")).count() == 0


# ---- 1


def test_raking():
    rng = np.random.default_rng(2)
    a, b = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    tokens, ta, tb = rng.integers(1, 1000, 12).astype(float), rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(3))
    w = mixing.rake(tokens, [(a, ta), (b, tb)])
    assert np.allclose(np.bincount(a, w), ta) and np.allclose(np.bincount(b, w), tb)
    ratio = (w / tokens).reshape(4, 3)  # raking scales by a factor per value, so cross ratios stay
    assert np.allclose(ratio[0, 0] * ratio[1, 1], ratio[0, 1] * ratio[1, 0])
    assert mixing._level(np.array([2.0, 1.0]), np.array([10.0, 100.0]), 60.0) == pytest.approx(0.5)


def test_mixing(spark, odd, empty):
    rng = np.random.default_rng(3)
    table = docs_of(spark, [(i, words(rng, 40)) for i in range(3000)]).withColumn("source", F.when(F.col("doc_id") % 10 == 0, "a").otherwise("b"))
    mixed = mixing.mix(table.withColumn("n", F.lit(40)), "n", {"source": {"a": 0.5, "b": 0.5}})
    assert {(r.source, round(r.probability, 6)) for r in mixed.collect()} == {("a", 1.0), ("b", round(1 / 9, 6))}
    taken = mixed.filter(mixing.chance("doc_id", "text") < F.col("probability")).groupBy("source").count()
    counts = {r[0]: r[1] for r in taken.collect()}
    assert counts["a"] == 300 and 240 < counts["b"] < 360
    assert mixing.mixed_documents(odd).count() == 9 and mixing.sample_mixture(odd).columns == odd.columns
    assert mixing.sample_mixture(empty).count() == 0


def test_a_rare_cell_thins_out_no_other(spark):
    rng = np.random.default_rng(12)
    table = docs_of(spark, [(i, words(rng, 40)) for i in range(1000)]).withColumn("source", F.when(F.col("doc_id") % 10 == 0, "a").otherwise("b"))
    rare = docs_of(spark, [(5000, "so few words")]).withColumn("source", F.lit("new")).withColumn("lang", F.lit("xx"))
    rows = mixing.mixed_documents(table.union(rare)).collect()
    expected = sum(r._tokens * r.probability for r in rows)
    assert expected == pytest.approx(mixing.BUDGET_SHARE * sum(r._tokens for r in rows))
    assert {r.probability for r in rows if r.doc_id == 5000} == {1.0}


def test_every_source_has_its_own_target(spark, monkeypatch):
    rng = np.random.default_rng(13)
    table = docs_of(spark, [(i, words(rng, 5 + i * 7 % 11)) for i in range(3600)])
    table = table.withColumn("source", F.concat(F.lit("host"), F.col("doc_id") % 1200)).withColumn("lang", (F.col("doc_id") / 1200).cast("int").cast("string"))
    found = []
    for limit in (mixing.DRIVER_BYTES, 0):
        monkeypatch.setattr(mixing, "DRIVER_BYTES", limit)
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-6 if not limit else mixing.TOLERANCE)
        rows = mixing.mixed_documents(table).collect()
        found.append({r.doc_id: r.probability for r in rows})
        sums, have = collections.Counter(), collections.Counter()
        for r in rows:
            sums[r.source] += r._tokens * r.probability
            have[r.source] += r._tokens
        total, raised = sum(have.values()), sum(n**mixing.POWER for n in have.values())
        assert sum(sums.values()) == pytest.approx(mixing.BUDGET_SHARE * total)
        assert max(r.probability for r in rows) < 1
        assert all(sums[k] == pytest.approx(mixing.BUDGET_SHARE * total * n**mixing.POWER / raised, rel=1e-2) for k, n in have.items())
    assert len(found[0]) == 3600 and all(found[1][k] == pytest.approx(p, rel=1e-2) for k, p in found[0].items())
    # Frequent values of a long margin are joined apart.
    monkeypatch.setattr(mixing, "fits_broadcast", lambda df: False)
    short = mixing.mix(table.withColumn("n", F.lit(40)), "n", {"source": {"host1": 0.5, mixing.OTHER: 0.5}}).collect()
    assert len(short) == 3600 and {(r.source == "host1", round(r.probability, 9)) for r in short} == {(True, 1.0), (False, round(3 / 3597, 9))}
    # Cells are those that occur, not all combinations of values.
    monkeypatch.undo()
    many = mixing.mixed_documents(table.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 170)))
    assert many.filter("probability > 0").count() == 3600


# ---- 10


def test_gradients():
    rng = np.random.default_rng(0)
    head = pa.array(["\n"] + [f"w{i}" for i in range(1, 2000)], pa.large_string())
    vocab = gru_lm.Vocabulary(head, (1e6 / np.arange(1, 2001)).astype(int), 10**6, 2000, np.full(gru_lm.RARE, 100.0), np.full(gru_lm.RARE, 10.0))
    gru = gru_lm.Gru({k: v.astype(float) for k, v in gru_lm.Gru.start(vocab).p.items()})
    x, y = rng.integers(0, 1077, (5, 3)), rng.integers(0, 1077, (5, 3))
    keep, state = np.ones((5, 3)), rng.standard_normal((gru_lm.HIDDEN, 3))
    keep[2, 1] = 0
    back, _, _ = gru.gradients(x, keep, y, state)
    for k in gru.NAMES:
        at = np.unravel_index(np.argmax(np.abs(back[k])), back[k].shape)
        losses = []
        for step in (1e-3, -2e-3):
            gru.p[k][at] += step
            losses.append(gru.gradients(x, keep, y, state)[2])
        gru.p[k][at] += 1e-3
        assert back[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-2, abs=1e-4)


def test_language_model(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'xy'[i % 2]}{rng.integers(300)}" for _ in range(60))) for i in range(400)] + [(r.doc_id, r.text) for r in odd.collect()]
    got = gru_lm.fit_and_score(docs_of(spark, rows)).collect()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    expected = sorted((str(i), h, len(t), sum(counts[w] > 0 for w in t), n, round(base(t), 4)) for (i, _), h, t in zip(rows, held, tokens))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    fresh = [r for r in got if r.held_out and r.n_tokens == 61]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert gru_lm.fit_and_score(empty).count() == 0


def some_model():
    head = pa.array(["\n"] + [f"w{i}" for i in range(1, 2000)], pa.large_string())
    vocab = gru_lm.Vocabulary(head, (1e6 / np.arange(1, 2001)).astype(int), 10**6, 2000, np.full(gru_lm.RARE, 100.0), np.full(gru_lm.RARE, 10.0))
    return gru_lm.Gru.start(vocab)


def one_by_one(gru, symbols):
    """The log-probability of one document, a symbol at a time."""
    state, before, total = np.zeros((gru_lm.HIDDEN, 1), np.float32), 0, 0.0
    for s in symbols.tolist():
        out, state = gru.run(np.array([[before]]), np.array([[float(before != 0)]], np.float32), state)
        total += float(gru.targets(out.reshape(gru_lm.HIDDEN, 1), np.array([s]))[0][0])
        before = s
    return total


def test_long_documents_beside_short_ones():
    rng, gru = np.random.default_rng(4), some_model()
    sizes = np.array([1, 20_000, 7, 1, 33, 64, 2, 500, 32] + [5] * 300)
    symbols = rng.integers(1, 1077, sizes.sum()).astype(np.int32)
    symbols[np.cumsum(sizes) - 1] = 0
    got = gru.document_logs(symbols, sizes)
    ends = np.cumsum(sizes)
    for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 308):
        assert got[i] == pytest.approx(one_by_one(gru, symbols[ends[i] - sizes[i] : ends[i]]), rel=1e-4)


def test_a_long_document_is_not_filled_up():
    rng, gru = np.random.default_rng(4), some_model()
    sizes = np.array([60_000] + [3] * 300)
    symbols = rng.integers(1, 1077, sizes.sum()).astype(np.int32)
    tracemalloc.start()
    gru.document_logs(symbols, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # one grid of 256 lanes would be 60 MB, two of them 120


# ---- pipeline


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in documents.collect()}
    toxic = toxicity.score_documents(documents, toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet")))
    left = {r.doc_id for r in toxic.collect() if not r.predicted}
    stage = documents.filter(F.col("doc_id").isin(list(left)))
    left &= {r.doc_id for r in bag_minhash.classes(stage).collect() if r.kept}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left -= {i for i in left if any(t in rows[i].text for t in items)}
    stage = documents.filter(F.col("doc_id").isin(list(left)))
    left = {r.doc_id for r in mixing.mixed_documents(stage).collect() if r._sampled}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(token_files.tokenizer_path()), 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = whole.encode(rows[r.doc_id].text, add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)

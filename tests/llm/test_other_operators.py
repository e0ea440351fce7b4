"""Chat, media, nearest neighbours, HTML and the pipeline: brute force, round trips and edge cases."""

import collections
import hashlib
import html.parser
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import ann, chat, htmltext, media

# -- chat

SAID = "</s>[INST] ok [/INST]"


def chat_rows():
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "again"), (1, 3, "assistant", "yes &amp; [end] <s>"), (1, 4, "assistant", None), (1, 5, "assistant", "more"),
        (2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "user", SAID), (3, 1, "assistant", SAID), (4, 0, None, None), (5, 0, "odd [role:x] & <y>", "é\n\n"),
        (6, 0, "user", "tie"), (6, 0, "assistant", "tie"), (6, 0, "assistant", "tie"), (None, 0, "user", "x"), (None, None, "assistant", ""), (7, 0, "assistant", "long " * 20_000),
    ]


def test_chat_round_trip(spark):
    rows = chat_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, t int, p string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        own.sort(key=lambda r: (low(r[0]), r[1], r[2]))
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_mask_and_merging(spark):
    frame = spark.createDataFrame(chat_rows()[:6], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(frame).first()
    text = row["formatted"]
    assert text.count("[role:") == 3 and text.count("[turn:") == 3 and text.count("[end]") == 3
    at, under = 0, []
    for run in row["loss_runs"]:
        at += run["skip"]
        under.append(text[at : at + run["take"]])
        at += run["take"]
    assert under == ["", "", "", "yes &amp;amp; &lb;end&rb; &lt;s>", "", "more"]
    assert chat.format_conversations(frame.limit(0)).count() == 0


# -- media


def payloads():
    rng = random.Random(1)
    texts = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, bytes(range(256)) * 5, b"\xff" * 1500, b"\0" * 1024, rng.randbytes(1024), rng.randbytes(1025), rng.randbytes(200_000)]
    return [media.payload_of(t) for t in texts]


def test_media_round_trip_is_exact():
    own = payloads()
    files = media.avi_files(own)
    for p, f, v in zip(own, files, media.read_files(files), strict=True):
        assert v.payload == p
        assert media.avi_files([p])[0] == f and media.read_files([f])[0].payload == p
        size = struct.unpack_from("<I", f, 4)[0]
        assert f[:4] == b"RIFF" and size + 8 == len(f)
        levels = np.frombuffer(p + b"\0" * (-len(p) % min(len(p), media.FRAME_BLOCKS)), np.uint8).reshape(len(v.means), -1)
        assert np.allclose(v.means, levels.mean(axis=1))
        assert np.allclose(v.histograms, [np.bincount(x // 8, minlength=32) / len(x) for x in levels])


def hand_made_frame(ac: bool) -> bytes:
    """One 8 x 8 image, coded by hand: DC 10, and with ``ac`` one coefficient of the first row."""
    dc, ac_codes = media._codes(media._DC_COUNTS, media._DC_SYMBOLS), {0x00: "0", 0x01: "10"}
    code, length = dc[4]
    bits = format(code, f"0{length}b") + format(10, "04b") + (ac_codes[0x01] + "1" if ac else "") + "0"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    counts = bytes([1, 1] + [0] * 14)
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0]))
    head += media._segment(0xC4, b"\x00" + bytes(media._DC_COUNTS) + bytes(media._DC_SYMBOLS)) + media._segment(0xC4, b"\x10" + counts + bytes([0x00, 0x01]))
    return head + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg_with_cosines():
    for ac in (False, True):
        frame = hand_made_frame(ac)
        t = media.parse_header(frame)
        dc, first, found = media.decode([frame], [t])
        assert dc.tolist() == [10] and found == ({(0, 1): 1} if ac else {})
        _, histogram, mean = media.levels(dc, first, found, t.quantizers[0])
        x = np.arange(8)
        want = 128 + 10 * 16 / 8 + (16 / np.sqrt(32) * np.cos((2 * x + 1) * np.pi / 16) if ac else 0 * x)
        assert abs(mean[0] - np.rint(want).mean()) < 1e-9
        assert np.allclose(histogram[0], np.bincount((np.rint(want) // 8).astype(int), minlength=32) / 8)


def test_shots():
    flat = lambda b: np.eye(32)[b]
    assert media.shots(np.array([flat(1)] * 4 + [flat(9)] * 3 + [flat(20)])) == [(0, 3), (4, 6), (7, 7)]
    assert media.shots(np.zeros((0, 32))) == [] and media.shots(np.array([flat(1)])) == [(0, 0)]


def test_media_columns(spark):
    rows = [(1, "one"), (1, "one"), (2, None), (3, ""), (None, "ünï"), (4, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, b"x", "f") for r in rows], "doc_id long, text string, media binary, feature string")
    out = media.round_trip(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        raw = (t or "").encode()
        own = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = by[i][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
    assert by[1][0] == by[1][1] and by[2][0]["media_sha256"] == by[3][0]["media_sha256"]
    files = media.encode_texts(docs)
    assert {(r["doc_id"], len(r["media"])) for r in files.collect()} == {(r["doc_id"], r["media_bytes"]) for r in out}
    clips = media.clips(files)
    assert clips.where("doc_id = 4").agg(F.max("last_frame")).first()[0] == -(-150_000 // 1024) - 1
    broken = spark.createDataFrame([(1, b"no video"), (2, None), (3, bytearray(files.first()["media"][:300]))], "doc_id long, media binary")
    assert {(r["doc_id"], r["first_frame"]) for r in media.clips(broken).collect()} == {(1, None)} | {(r["doc_id"], r["first_frame"]) for r in media.clips(broken).where("doc_id = 3").collect()}
    assert media.round_trip(docs.limit(0)).count() == 0


# -- nearest neighbours


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted((-float(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    same = vectors[7].tolist()
    rows += [(5000 + i, same) for i in range(60)]  # copies
    rows += [(6000, None), (6020, []), (6040, [0.0] * 16), (6060, [float("nan")] * 16), (6080, [float("inf")] * 16), (6100, [None] * 16), (None, same), (6120, [1.0, 2.0]), (6121, [1.0, 1.0]), (6140, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id int, dim int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(rows, 20, 20)
    clean = ann.clean(frame)
    for shard in (400, 10_000):
        out = ann.nearest(clean.where("id % 20 = 0"), ann.build_index(clean, shard_most=shard), 20).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(got) == {q for q, near in want.items() if near}
        hit = total = 0
        truth = dict(rows)
        for q, near in got.items():
            assert len(near) == len(want[q]) and len({v for v, _ in near}) == len(near)
            assert near == sorted(near, key=lambda x: (-x[1], x[0]))
            for v, score in near:
                assert abs(score - sum(a * b for a, b in zip(truth[q], truth[v], strict=True))) < 1e-9
            hit += len({v for v, _ in near} & {v for v, _ in want[q]})
            total += len(near)
        assert hit / total > 0.97
    assert got[6120] == [(6121, 3.0)]
    assert ann.search_table(frame.limit(0)).count() == 0


def recall(spark, vectors, **options):
    """Share of the true 20 nearest (by score, as ties are many) of each 20th vector that the search finds."""
    ids = [i * 20 if i < 150 else 100_000 + 20 * i + 1 for i in range(len(vectors))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search_table(frame).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = 0
    for i in range(150):
        score = ann.inner_products(vectors[i : i + 1], vectors[None])[0]
        score[i] = -np.inf
        best = np.sort(score)[::-1][:20]
        hit += (np.sort(got[ids[i]])[::-1] >= best[-1]).sum()
    return hit / (150 * 20)


def test_recall_of_hard_vectors(spark):
    rng = np.random.default_rng(8)
    small = rng.normal(size=(3000, 24))
    long = small.copy()
    long[77] *= 1e6
    long[78] *= 1e4
    copies = small.copy()
    copies[500:2500] = copies[500 + np.arange(2000) % 3]
    wide = rng.normal(size=(6000, 128))
    spread = small * 10.0 ** rng.uniform(-3, 3, (3000, 1))
    cases = {"long": long, "huge": small * 1e25, "tiny": small * 1e-200, "copies": copies, "spread": spread, "unit": wide / ann.norms_of(wide)[:, None]}
    found = {name: recall(spark, v) for name, v in cases.items()}
    assert min(found.values()) >= 0.95, found


def test_queries_that_share_an_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (0, [1.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [3.0, 1.0])]
    out = ann.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == []
    out = ann.search_table(spark.createDataFrame([r for r in rows if len(r[1]) > 1], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(1, 4, 10.5), (2, 4, 9.0), (3, 3, 0.5)]


def test_graph_has_no_repeated_links():
    vectors = np.random.default_rng(0).normal(size=(700, 8))
    g = ann.build(vectors / ann.norms_of(vectors).max())
    for rows in g.links:
        for r in rows:
            own = r[r >= 0]
            assert len(set(own.tolist())) == len(own)
    assert ann.build(np.zeros((0, 8))).entry == -1


# -- HTML

PAGES = {
    "<p>One <b>two</b>\n three<p>Four<br>five": "One two three\n\nFour\nfive",
    "<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>": "* a\n* b\n  1. x\n  2. y\n* c",
    "<ol start=3><li>a</ol>": "3. a",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>": "Name       Qty\napple pie  3",
    "<table><tr><td>a<td>b<td>c<tr><td colspan=2>wide cell<td>d</table>": "a  b       c\nwide cell  d",
    "<head><title>t</title><style>p{margin:0}.h,#i{display:none}</style></head><p>a<p>b<p class='x h'>c<p id=i>d": "a\nb",
    "<pre>\n  x\n    y</pre>z": "  x\n    y\n\nz",
    "<div hidden>no</div><span style='DISPLAY : none'>no</span>yes<script>no</script><!-- no --><noscript>no</noscript>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<dl><dt>T<dd>D<dt>U<dd>E</dl>": "T\n    D\nU\n    E",
    "a &lt; b &amp;&nbsp;c &eacute;": "a < b &\xa0c é",
    "": "", "<": "<", "<!-- x": "", "<script>x": "", "</p>": "", "<div>" * 3000 + "deep": "deep",
}


@pytest.mark.parametrize("source", PAGES)
def test_html(source):
    assert htmltext.visible_text(source) == PAGES[source]


def test_html_stray_table_text_and_media():
    text = htmltext.visible_text
    assert text("<p>x</p><table>one<tr>two<td>a<td>b</tr>three</table>y") == "x\n\nonetwothree\n\na  b\n\ny"
    assert text("<table><tbody>s<tr><td>a</td>&amp;</tr></tbody><thead>t</thead><tfoot>u</table>") == "s&tu\n\na"
    assert text("<table><tr><td>o<table>in<tr><td>a</table></table>") == "oin\n\na"
    assert text("<table style='display:none'>seen<tr><td>unseen</table>") == "seen"
    assert text("<tr>alone") == "alone"
    page = "<style>{}</style><p class=nav>nav</p><p>text</p>"
    hide = ".nav{display:none}"
    for css in (f"@media print{{{hide}}}", f"@media print{{p{{color:red}}{hide}}}", f"@media not screen{{{hide}}}", f"@media (max-width:600px){{{hide}}}", f"@media print{{@supports (x:y){{{hide}}}}}", f"@media print{{{hide}"):
        assert text(page.format(css)) == "nav\n\ntext", css
    for css in (hide, f"@media screen{{{hide}}}", f"@media print, screen{{{hide}}}", f"@media only screen and (min-width: 40em){{{hide}}}", f"@media print{{p{{display:none}}}}{hide}", f"@media not print{{{hide}}}", f"@media screen{{b{{color:red}}}}{hide}"):
        assert text(page.format(css)) == "text", css
    assert text("<style media=print>.nav{display:none}</style><p class=nav>nav") == "nav"


def test_html_of_any_depth():
    """Hidden stays hidden and shown stays shown however deep, in time in proportion to the page."""
    deep = "<div>" * 300
    assert htmltext.visible_text(f"{deep}<p hidden>no<p>yes") == "yes"
    assert htmltext.visible_text("<div><span hidden>no</span>" * 20_000 + "yes" + "</div></p><p>" * 20_000 + "end") == "yes\n\nend"
    quoted = htmltext.visible_text("<blockquote>" * 500 + "yes")
    assert quoted.strip() == "yes" and len(quoted) < 300
    assert htmltext.visible_text("<b>" * 30_000 + "<p>a" * 3) == "a\n\na\n\na"


VISIBILITY = {
    "<style>div.z{display:none}</style><div class=z>no</div><p class=z>yes": "yes",
    "<style>.a.b{display:none}#i.a{display:none}</style><p class=a>yes<p class='a b'>no<p class=a id=i>no": "yes",
    "<style>.a{display:none} .a{display:block}</style><p class=a>yes": "yes",
    "<style>#i{display:block} .a{display:none}</style><p class=a id=i>yes<p class=a>no": "yes",
    "<style>.a{display:none}</style><p class=a style='display:block'>yes": "yes",
    "<style>.a{display:none!important}</style><p class=a style='display:block'>no": "",
    "<style>/* .a{ */ .b{display:none} /* } */</style><p class=a>yes<p class=b>no": "yes",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b><i>no</i></div>": "yes",
    "<div style='display:none'>no<b style='visibility:visible;display:inline'>no</b></div>yes": "yes",
    "<style>.v{visibility:hidden}.v *{color:red}td.w{visibility:visible}</style><table class=v><tr><td>no<td class=w>yes</table>": "  yes",
    "<style>p .a{display:none}p>b{display:none}a:hover{display:none}</style><p><b class=a>yes</b> <a>too</a>": "yes too",
    "<p data-style='display:none'>yes<p style='x-display:none'>too<p class='hidden'>also": "yes\n\ntoo\n\nalso",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td>x<td rowspan=0>all<td>y<tr><td>long cell<td>z<tr><td>u<td>v</table>": "x          all  y\nlong cell       z\nu               v",
    "<table><tr><td rowspan=99 colspan=2>a<td>b<tr><td>c</table>": "a   b\n    c",
}


@pytest.mark.parametrize("source", VISIBILITY)
def test_html_visibility_and_spans(source):
    assert htmltext.visible_text(source) == VISIBILITY[source]


class Words(html.parser.HTMLParser):
    """Brute force: words of all text outside what is not shown, for pages whose tags are closed."""

    def __init__(self):
        super().__init__()
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attributes):
        attributes = dict(attributes)
        if tag not in htmltext.VOID and (self.hidden or tag in htmltext.UNSEEN or "hidden" in attributes or "display:none" in (attributes.get("style") or "")):
            self.hidden.append(tag)
        elif tag in htmltext.BLOCKS or tag in ("br", "td", "th"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in htmltext.BLOCKS or tag in ("td", "th"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def brute_words(source):
    words = Words()
    words.feed(source)
    words.close()
    return "".join(words.parts).split()


def random_page(rng, depth=0):
    """Nested blocks, lists, tables and hidden parts, all closed; words are letters only."""
    word = lambda: "".join(rng.choices("abcdef", k=4))
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.randrange(9) if depth < 5 else 0
        inner = lambda: random_page(rng, depth + 1)
        out.append(
            [
                lambda: f" {word()} <b>{word()}</b>{word()} ",
                lambda: f"<div>{inner()}</div>",
                lambda: f"<p>{word()}<br>{word()}</p>",
                lambda: "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + "</ul>",
                lambda: "<table>" + "".join("<tr>" + "".join(f"<td{rng.choice(['', ' colspan=2', ' rowspan=2'])}>{inner()}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>",
                lambda: f"<div hidden>{inner()}</div>",
                lambda: f"<section style='display:none'>{inner()}</section>",
                lambda: f"<script>{word()}</script><!-- {word()} -->",
                lambda: f"<blockquote>{inner()}</blockquote>",
            ][kind]()
        )
    return "".join(out)


def test_html_against_brute_force(spark):
    """Every text that is not hidden is in the output, each as often, and nothing else but bullets."""
    rng = random.Random(3)
    pages = [random_page(rng) for _ in range(300)]
    pages += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        found = htmltext.visible_text(page).split()
        assert collections.Counter(x for x in found if x != "*") == collections.Counter(brute_words(page)), page


def test_html_never_fails_and_keeps_visible_words():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<div", ">", "<", "\"", "'", "&", "&#x41;", "<!--", "-->", "<pre>", "</pre>", "word", " ", "\n", "<td colspan=99999999>", "</td>", "<br>", "<hr>", "<caption>", "<dd>", "<a href='", "</html>", "<select><option>"]
    for _ in range(1500):
        htmltext.visible_text("".join(rng.choices(bits, k=rng.randint(1, 40))))
    for _ in range(300):
        source = "".join(rng.choice(["<p>", "<div>", "<li>", "<td>", "<table><tr><td>", "</div>", "</table>", "<ul>", "<b>"]) + f" w{i} " for i in range(rng.randint(1, 25)))
        words = [w for w in htmltext.visible_text(source).split() if w != "*"]
        assert sorted(words) == sorted(w for w in source.replace(">", " ").replace("<", " ").split() if w[0] == "w")


def test_html_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", ""), (3, "w", "<td>" * 20_000 + "x"), (4, "l", "<p>word " * 20_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = [tuple(r) for r in htmltext.extract(pages).collect()]
    assert len(out) == len(rows) and out.count((1, "u", "a")) == 2 and (2, None, None) in out and (None, "v", "") in out
    assert htmltext.extract(pages.limit(0)).count() == 0


# -- the pipeline


def corpus(spark):
    rng = random.Random(8)
    sounds = {"aa": ["bla", "blo", "bli", "stra"], "zz": ["kwe", "kwo", "xen", "yzz"]}

    def text(lang, lines):
        return "\n".join(" ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(12)) for _ in range(lines))

    rows = [(i, text(lang, rng.randint(1, 8)), lang, f"s{i % 4}") for i in range(150) for lang in [rng.choice(["aa", "zz"])]]
    rows += [(1000 + i, rows[i][1], rows[i][2], "s0") for i in range(10)]  # copies
    near = [f"{w}{i}" for i, w in enumerate(text("aa", 8).split())]
    rows += [(2000, " ".join(near), "aa", "s1"), (2001, " ".join([*near[:-1], "blablabla"]), "aa", "s2")]  # near copies, on one line each
    rows += [(3000, None, "aa", "s1"), (3001, "12 34", None, None), (3002, "", "zz", "s1")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline(spark, tmp_path):
    docs = corpus(spark)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    step, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, folder).write.parquet(f"{folder}/{name}")
        step = spark.read.parquet(f"{folder}/{name}")
        seen.append(step)
        if name != "packing":
            assert step.columns == docs.columns
    kept = {r["doc_id"] for r in seen[0].collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {3000, 3001, 3002}
    lines = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    assert kept - set(lines) == set(range(1000, 1010))  # copies lose all their lines
    assert {r["doc_id"] for r in seen[2].collect()} == set(lines) - {2001}
    words, mixed = ({r["source"]: r["n"] for r in step.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()} for step in seen[2:4])
    assert abs(sum(mixed.values()) - sum(words.values())) <= 4
    assert mixed["s2"] > mixed["s1"] > mixed["s0"]
    assert seen[4].count() == seen[3].count()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[4].collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)

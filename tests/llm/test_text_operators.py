"""Words, packing, subwords, chat and pages against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.llm import chat, packing, subwords, tagpath, words
from lanewise.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "a b", "  two  words \n", "é ñandú  ß", "x" * 70_000, "a\x0bb\x0cc\rd\te", "漢字 😀 \x1c y", "the the the the the the", "line\nline\n\nline", " <|endoftext|> Σας İ"]
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_words_and_hashes():
    texts = ODD * 3
    found = [[] for _ in texts]
    seen = {}
    for limit in (1, 64, 1 << 20):
        found = [[] for _ in texts]
        for w in words.slices(pa.array(texts), limit):
            for row, word, h in zip(w.row, w.texts(), w.hashes()):
                found[w.lo + row].append(word.decode())
                assert seen.setdefault(word, h) == h
        assert found == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)
    assert list(words.slices(pa.array([], pa.string()))) == []


def test_long_words_that_differ_in_one_place_have_hashes_of_their_own():
    n = 3 * (1 << 16)
    texts = ["x" * k + "y" + "x" * (n - k - 1) for k in (0, 5, 65_536, 65_541, 131_072, 131_077)] + ["x" * 65_536, "x" * 65_537]
    found = [h for w in words.slices(pa.array(texts)) for h in w.hashes()]
    assert len(set(found)) == len(texts)
    (both,) = words.slices(pa.array([texts[0] + " short", "short"]))
    assert both.hashes()[0] == found[0] and both.hashes()[1] == both.hashes()[2]


def test_shingle_bags_are_multisets():
    texts = ["a b c d e f a b c d e", "a b c d e", "a b", "", None, "b a"]
    (w,) = words.slices(pa.array(texts))
    row, h, n = words.shingle_bags(w, 5)
    assert [int(n[row == r].sum()) for r in range(6)] == [7, 1, 1, 0, 0, 1]
    assert h[row == 1][0] in h[row == 0] and int(n[row == 0].max()) == 2
    assert h[row == 2][0] != h[row == 5][0]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer
    import public_tokenizers

    encode, theirs = packing.Encoder(packing.VOCABULARY), Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [t or "" for t in ODD] + ["It's we'LL 'S ''s a'b 12 3½ x²", "É Ç Ñ don’t", "a\xa0b", "U.S.A. $5,000!!"]
    for t in texts:
        assert np.frombuffer(encode(t), encode.width).tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_encoder_on_random_words():
    """Plain words are merged through a part of another library that isn't its public face; an update may not change ids."""
    import random

    from tokenizers import Tokenizer
    import public_tokenizers

    random.seed(9)
    encode, theirs = packing.Encoder(packing.VOCABULARY), Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    letters = "aaeeiioouutnrslcdmpghbfvwyjkqxzéèüñßÀÖ0123456789'.,-!?$&()"
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(40)) for _ in range(1500)]
    for t, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(t), encode.width).tolist() == want.ids, t


def test_packing_round_trip(spark):
    texts = [(k, t) for k, t in enumerate(ODD * 4)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit(5)).withColumn("ids", F.lit("x")).repartition(3)
    rows = packing.packed(docs, length=64).orderBy("sequence_id", "offset").collect()
    encode = packing.Encoder(packing.VOCABULARY)
    filled: dict[int, int] = {}
    for r in rows:
        assert r.offset == filled.get(r.sequence_id, 0) and r.length == len(r.ids) // 4
        filled[r.sequence_id] = r.offset + r.length
    last = max(filled)
    assert sorted(filled) == list(range(last + 1)) and all(filled[k] == 64 for k in range(last)) and filled[last] <= 64
    whole, parts = [], []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            parts = []
        assert sum(len(p) for p in parts) // 4 == r.start
        parts.append(bytes(r.ids))
        if r.start + r.length == r.doc_tokens:
            whole.append((r.doc_id, b"".join(parts)))
    want = [(k, np.append(np.frombuffer(encode(t or ""), encode.width), 2).astype("<u4").tobytes()) for k, t in texts]
    assert sorted(whole, key=str) == sorted(want, key=str)
    padded = packing.sequences(packing.packed(docs, length=64), 64).collect()
    assert all(len(p.ids) == 256 for p in padded) and sum(p.n_padding for p in padded) == 64 - filled[last]
    assert packing.packed(docs.limit(0)).count() == 0


def test_subwords_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers

    theirs = SentencePieceProcessor(model_file=public_tokenizers.path(subwords.MODEL))
    more = ["  a", "a  b   c", " a ", "<s> </s> <0x0A>", "ﬁ Å", "aaaa" * 50, "http://www.example.com/?a=b", " " * 40 + "x", "3.14159"]
    rows = [(k, t) for k, t in enumerate(ODD + more)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("decoded", F.lit("x")).withColumn("ids", F.lit(1))
    got = {r.doc_id: r for r in subwords.decoded(subwords.encoded(df)).collect()}
    for k, t in rows:
        assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == theirs.encode(t or ""), t
        assert got[k].decoded == (t or "")
    assert subwords.encoded(df.limit(0)).count() == 0
    coder = subwords.Coder(subwords.pieces())
    before = coder.encode(["shared prefix sharing"])
    assert before == coder.encode(["shared prefix sharing"])


def test_subword_memory_is_bounded_and_changes_nothing(monkeypatch):
    texts = [" ".join(f"word{k * k % 977}x{k % 13}" for k in range(n, n + 300)) + " 漢é▁" for n in range(0, 6000, 300)]
    want = subwords.Coder(subwords.pieces()).encode(texts)
    monkeypatch.setattr(subwords, "REMEMBERED", 20_000)
    monkeypatch.setattr(subwords, "LINKS", 50)
    coder, got = subwords.Coder(subwords.pieces()), []
    for t in texts:
        got += coder.encode([t])
        assert coder.held < 20_000 + 400 * 200 and len(coder.links) <= 50
    assert got == want


def test_forward_scores_are_the_sums_of_their_pieces():
    coder = subwords.Coder(subwords.pieces())
    words = sorted([" the", " then", " theory", " x漢", "é"])
    for word, (ids, score) in zip(words, coder.segmented(words)):
        alone, total = next(subwords.Coder(subwords.pieces()).segmented([word]))
        assert (ids, score) == (alone, total) and score == sum(coder.model.score.get(i, 0.0) for i in ids)


def test_two_long_words_that_part_early_take_linear_time():
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers

    text = "x" * 300_000 + "a x" + "y" * 300_000 + " " + "x" * 300_000 + "b"
    theirs = SentencePieceProcessor(model_file=public_tokenizers.path(subwords.MODEL)).encode(text)
    began = time.process_time()
    assert np.frombuffer(subwords.Coder(subwords.pieces()).encode([text])[0], "<u4").tolist() == theirs
    assert time.process_time() - began < 30


def plain_escape(t):
    return re.sub(r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)", r"\1\\\2\3", t)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "a\\</s>", "[\\\\INST] x", "<<SYS>>a<</SYS>>", "", " ", None, "plain", "<", "[", "</s", " [/INST]", "\n"]
    rows = [(c, t, ("user", "assistant", "system =%", None)[(c + t) % 4], x) for c in range(4) for t, x in enumerate(nasty)] + [(9, 0, "user", "a"), (9, 0, "user", "a"), (None, None, "assistant", "b"), (10, 3, "assistant", "y"), (10, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    masks = {r.conv_id: r.masked for r in chat.masked(chat.formatted(df)).collect()}
    digests = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        turns = [(role, t) for _, role, t in mine]
        assert [(t.role, t.text) for t in got[conv].turns] == turns and got[conv].identical
        loss = [t for role, t in turns if role == "assistant"]
        spans = [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].spans]
        assert spans == [plain_escape(t) for t in loss]
        assert masks[conv] == loss
        d = digests[conv]
        assert d.n_turns == len(turns) and d.loss_chars == len("".join(loss)) and d.formatted_chars == len(got[conv].formatted)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
    assert got[9].n_escaped == 0 and got[0].n_escaped > 0
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_against_sql_and_plan(spark):
    df = QUERIES["op2_grammar_round_trip"](spark, SF)
    assert_same(df, connect(SF), ORACLES["op2_grammar_round_trip"])
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T. t.</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site, name.</h1></header><nav><ul><li><a href="/a">Menu, one.</a></li></ul></nav><div class="ad">Buy now, quickly, today.</div>
<div id="cookie-notice">We use cookies, of course.</div><article><header><h1>Head &amp; line</h1></header><p><b>One  two,<br>three.<p>Four &lt;five&gt;&nbsp;six.
<blockquote>Said, said.</blockquote><ul><li>a</li><li>b, c</ul><form><label>Name</label></form><aside>Also, this.</aside><script>x()</script></article>
<section class="comments"><p>I disagree, strongly, with all of it. Really.</p></section><aside>More, more.</aside><footer>End, end.</footer>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Head & line\nOne two, three.\nFour <five> six.\nSaid, said.\na\nb, c"),
        ("<p>Plain, text.</p>", "Plain, text."),
        ("<div><p>A long paragraph, with commas. And more.</p><div class='sidebar'>No, no.</div></div>", "A long paragraph, with commas. And more."),
        ("", ""),
        (None, ""),
        ("no tags < at all", "no tags < at all"),
        ("<main><p>unclosed <i>tag</main>", "unclosed tag"),
        ("<!-- a comment", ""),
        ("<script>never ends", ""),
    ],
)
def test_main_text(page, text):
    assert tagpath.main_text(page) == text


PROSE = "<p>" + "Some words of prose, and more of them; a sentence ends here. " * 4 + "</p>"


@pytest.mark.parametrize("links", [1, 2, 5, 10, 20, 40])
def test_paths_part_text_from_links_without_telling_names(links):
    line = " ".join(PROSE[3:-4].split())
    menu = "<ul>" + "<li><a href='/x'>Page 1</a></li>" * links + "</ul>"
    assert tagpath.main_text(f"<body><div>{menu}</div><div>{PROSE * 20}</div></body>") == "\n".join([line] * 20)
    assert tagpath.main_text(f"<body><div>{PROSE * 20}</div><div>{menu.replace('<a', '<i').replace('</a', '</i') if links > 2 else menu}</div></body>") == "\n".join([line] * 20)
    assert tagpath.main_text(f"<body><article>{PROSE * 5}{menu}<ul><li>short</ul></article></body>") == "\n".join([line] * 5 + ["short"])


def test_paths_keep_links_and_headings_of_text():
    line = " ".join(PROSE[3:-4].split())
    linked = PROSE.replace("prose", "<a href='/p'>prose</a>")
    assert tagpath.main_text(f"<body><h2><a href='/h'>Head</a></h2>{linked * 3}</body>") == "\n".join(["Head"] + [line] * 3)
    assert tagpath.main_text("<ul><li><a href='/x'>Only</a><li><a href='/y'>links</a></ul>") == "Only\nlinks"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><div style="overflow:hidden"><p>Text one, here.</p></div><p>Two.</p></article>', "Text one, here.\nTwo."),
        ('<article><div title="a hidden gem"><p>Text one.</p></div></article>', "Text one."),
        ("<article><p data-id='comments'>Text.</p></article>", "Text."),
        ('<article><div class="post-header"><h1>Head</h1></div><p>Body text, long. More of it.</p></article>', "Head\nBody text, long. More of it."),
        ("<article><p title=don't>Some text.</p><p>it's here</p></article>", "Some text.\nit's here"),
        ("<article><p hidden>No.</p><p aria-hidden=TRUE>No.</p><p data-x=\"a>b\">Yes.</p></article>", "Yes."),
    ],
)
def test_attributes_are_read_by_name(page, text):
    assert tagpath.main_text(page) == text


def unmarked(page):
    """Without article, nav, footer and telling classes: nothing but the ratios tells the text."""
    for name in ("article", "nav", "footer"):
        page = page.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
    return page.replace('<div class="ad">', "<div>")


def test_ratios_and_their_cut_find_the_text(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    marked = [tagpath.main_text(p) for p in pages]
    plain = [tagpath.main_text(unmarked(p)) for p in pages]
    assert np.mean([p == t for p, t in zip(plain, marked)]) >= 0.86
    assert np.mean([set(t.split("\n")) <= set(p.split("\n")) for p, t in zip(plain, marked)]) >= 0.99
    monkeypatch.setattr(tagpath, "level", lambda *_: -np.inf)
    assert all(tagpath.main_text(p) != t for p, t in zip(pages, marked))


KINDS = {
    "quote": ("<blockquote>Said so.</blockquote>", "Said so."),
    "code": ("<pre>x = 1</pre>", "x = 1"),
    "list": ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"),
    "caption": ("<figure><img src=x><figcaption>A view</figcaption></figure>", "A view"),
    "table": ("<table><tr><td>a1</td><td>b2</td></tr></table>", "a1\nb2"),
    "terms": ("<dl><dt>Term</dt><dd>Meaning</dd></dl>", "Term\nMeaning"),
    "short": ("<p class=x>Short one</p>", "Short one"),
    "linked": ("<p><a href=/x>A long title of a linked report that fills</a> it.</p>", "A long title of a linked report that fills it."),
    "link": ("<p><a href=/x>A whole link</a></p>", "A whole link"),
    "related-work": ("<div class='related-work'><p>Others did it, too.</p></div>", "Others did it, too."),
    "social-history": ("<div class='social-history'><p>Then.</p></div>", "Then."),
    "comment-history": ("<div class='comment-history'><p>Then, x.</p></div>", "Then, x."),
    "controls": ("<p>Press <button>Go</button> and <label>read</label> on.</p>", "Press Go and read on."),
    "hint": (f"<div class=social>{PROSE}</div>", " ".join(PROSE[3:-4].split())),
    "rounds": ("<header><h2>Part</h2></header>", "Part"),
}
MENUS = "<header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"
ENDS = "<aside><p>Also read this and that.</p></aside><div class=sidebar>Side text, short.</div><footer>Copyright by us.</footer>"
SURROUNDINGS = {
    "article alone": ("", "<article>", "</article>", ""),
    "article with menus": (MENUS, "<article>", "</article>", ENDS),
    "plain with menus": (MENUS, "<div class=content>", "</div>", ENDS),
    "plain alone": ("", "<div>", "</div>", ""),
    "flat": ("", "", "", ""),
}


@pytest.mark.parametrize("around", SURROUNDINGS)
@pytest.mark.parametrize("kind", KINDS)
def test_articles_stay_whole(kind, around):
    if (kind, around) == ("rounds", "flat"):
        return  # nothing parts this header from one of a site
    before, opened, closed, after = SURROUNDINGS[around]
    block, text = KINDS[kind]
    line = " ".join(PROSE[3:-4].split())
    for at in range(6):
        blocks = [PROSE] * 5
        blocks.insert(at, block)
        page = f"<html><body>{before}{opened}<h1>Title of it</h1>{''.join(blocks)}{closed}{after}</body></html>"
        assert tagpath.main_text(page) == "\n".join(["Title of it", *[line] * at, text, *[line] * (5 - at)])


def plain_scores(blocks, marked):
    """path_scores without arrays: every sum written out."""
    kernel = {d: math.exp(-0.5 * (d / tagpath.SPREAD) ** 2) for d in (-1, 0, 1)}
    n = len(blocks)

    def smooth(x):
        near = lambda k: [(kernel[d], x[k + d]) for d in kernel if 0 <= k + d < n]
        return [sum(w * v for w, v in near(k)) / sum(w for w, _ in near(k)) for k in range(n)]

    of = {}
    for b in blocks:
        of.setdefault(b.key, []).append(b)
    mean = lambda x: [sum(v for v, o in zip(x, blocks) if o.key == b.key) / len(of[b.key]) for b in blocks]
    links, all_ = smooth([b.linked for b in blocks]), smooth([b.chars for b in blocks])
    text = mean([1 - b.linked / b.chars if b.menu else 1 - x / y for b, x, y in zip(blocks, links, all_)])
    length, points = mean([b.chars for b in blocks]), mean([b.marks for b in blocks])
    ratio = [math.sqrt(x * (1 + y)) for x, y in zip(smooth([x * t for x, t in zip(length, text)]), smooth([x * t for x, t in zip(points, text)]))]
    for k in reversed(range(n - 1)):
        if blocks[k].place.heading:
            ratio[k], text[k] = max(ratio[k : k + 2]), max(text[k : k + 2])
    best = max(mean(ratio))
    out = {}
    for b, own, share in zip(blocks, mean(ratio), mean(text)):
        _, part, named, inside, _ = b.key
        own = own / best if best else 0
        hinted = named == 2 or (named == 1 and own < tagpath.LOW)
        score = (tagpath.MARKED + (1 - tagpath.MARKED) * own if inside else own) * share
        score *= (tagpath.PART if part else 1) * (tagpath.NAMED if hinted else 1) * (tagpath.OUTSIDE if marked and not inside else 1)
        out[b.key] = score, sum(o.chars for o in of[b.key])
    return out


def test_path_scores_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        blocks = []
        for _ in range(rng.randint(1, 30)):
            place = tagpath.Place("p", block_path=rng.randint(0, 4), part=rng.random() < 0.1, header=rng.random() < 0.1, named=rng.choice([0, 0, 0, 1, 2]), heading=rng.random() < 0.2)
            chars = rng.randint(1, 300)
            blocks.append(tagpath.Block(place, [], chars, rng.randint(0, 9), rng.choice([0, 0, chars, rng.randint(0, chars)]), rng.random() < 0.2, rng.random() < 0.6))
        for marked in (True, False):
            ours, theirs = tagpath.path_scores(blocks, marked), plain_scores(blocks, marked)
            assert ours.keys() == theirs.keys()
            assert all(ours[k][0] == pytest.approx(theirs[k][0]) and ours[k][1] == theirs[k][1] for k in ours)


def test_cut_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([0.03, 0.1, 0.33, 0.36, 0.7, 0.92, 1.0]) for _ in range(rng.randint(1, 8))]
        weights = [rng.randint(1, 50) for _ in scores]
        best, bar = 0, -math.inf
        for c in sorted(set(scores))[1:]:
            low, high = ([(s, w) for s, w in zip(scores, weights) if (s >= c) == up] for up in (False, True))
            mean = lambda x: sum(s * w for s, w in x) / sum(w for _, w in x)
            gap = mean(high) - mean(low)
            if c - max(s for s, _ in low) >= tagpath.APART - 1e-12 and gap >= tagpath.LEVELS - 1e-12:
                between = sum(w for _, w in low) * sum(w for _, w in high) * gap**2
                if between > best + 1e-9:
                    best, bar = between, c
        assert tagpath.level(np.array(scores), np.array(weights, float)) == bar


def test_deep_pages_take_linear_time():
    began = time.process_time()
    assert tagpath.main_text("<div><b>" * 30_000 + "text" + "</i>" * 30_000) == "text"
    assert time.process_time() - began < 10


def test_pages_have_their_articles(spark):
    rows = {r.page_id: r for r in QUERIES["op5_tag_path_ratios"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = p.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(re.sub("<[^>]+>", "", b).split()) for b in re.split("</?(?:p|h1)>", article)]
        import html

        assert rows[p.page_id].text == "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", "<p>a b.</p>"), (1, "u", "<p>a b.</p>"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "long, text. " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("key", F.lit(2)).withColumn("page", F.lit(3)).withColumn("n_chars", F.lit(4))
    got = sorted((r.page_id or 0, r.n_chars) for r in tagpath.extracted(df).collect())
    assert got == [(0, 0), (1, 4), (1, 4), (2, 0), (3, 12 * 20000 - 1)]
    assert tagpath.extracted(df.limit(0)).count() == 0


def test_crc_is_zlibs(spark):
    r = QUERIES["op3_concat_and_cut"](spark, SF).orderBy("doc_id", "start").first()
    t = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    encode = packing.Encoder(packing.VOCABULARY)
    ids = np.append(np.frombuffer(encode(t), encode.width), 2).astype("<u4")[: r.length]
    assert r.ids_crc32 == zlib.crc32(ids.tobytes())

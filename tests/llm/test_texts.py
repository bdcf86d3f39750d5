"""Extraction, SentencePiece, quality counts, URL rules and preference rows against plain Python."""

import hashlib
import html
import random
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plain import documents, write
from rinseframe.llm import extraction, pieces, preferences, quality, queries, url_filter

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


# ---- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def check_pieces(frame, texts, library):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect()}
    expected = {}
    for doc_id, text in texts:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        expected[doc_id] = (len(ids), *digests)
    assert found == expected


def test_pieces_of_all_documents(spark, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(queries.op6_piece_merge_rounds(spark, SF), texts, library)


def test_pieces_of_odd_texts(spark, tmp_path, library):
    rng = random.Random(4)
    texts = [None, "", " ", "  ", " " * 5000, "a" * 5000, "▁▁x ▁", "\n\n a\n", "<s> </s> <0x41> <unk>", "日本語 😀 ﷽", "\x00\x01", "x\u0301 é"]
    texts += ["".join(rng.choices("abcdefghij-=_", k=3000)), "=" * 3000 + " " + "0" * 700, "the " * 4000, "ab  cd   ef    gh\t\t x"]
    texts = list(enumerate(texts + texts[5:8]))
    write(spark, documents(texts), tmp_path)
    check_pieces(queries.op6_piece_merge_rounds(spark, str(tmp_path)), texts, library)
    empty = pieces.encoded(spark.createDataFrame([], "IDS int, text string"), "text", queries.PIECE_MODEL)
    assert empty.columns == ["ids"] and empty.collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdeths ▁\n.=é日\u200b"), max_size=60) | st.text(max_size=40), st.sampled_from([2, 256]))
def test_ids_are_those_of_the_library(text, longest):
    own = pieces.model(queries.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    own.known.clear()
    before, pieces.LONGEST = pieces.LONGEST, longest
    try:
        ids = own.encode_all([text, text])
    finally:
        pieces.LONGEST = before
    assert ids[0].tolist() == ids[1].tolist() == library.encode(text)
    assert own.decode(ids[0].tolist()) == library.decode(ids[0].tolist())


def test_decoding_any_ids():
    own, library = pieces.model(queries.PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = random.Random(7)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randrange(1, 12))]
        assert own.decode(ids) == library.decode(ids), ids


# ---- extraction

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b> words\n and <a href='x'>a link</a>.<p>Second&nbsp;one<br>after break</article>"
TEXT = "Title & more\n\nFirst bold words and a link.\n\nSecond one after break"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "before",
    [
        "",
        "<nav><ul><li><a href='/a'>A</a></li></ul></nav>",
        "<header><h1>Site</h1><p>Slogan of the site</p></header>",
        "<div class='cookie-notice'>We use cookies</div>",
        "<div class=\"ad\">Buy now</div><!-- <article>hidden</article> -->",
        "<aside><p>Beside the point</p></aside>",
        "<form action='/s'><label>Name</label><input name='a>b'></form>",
        "<div role='navigation'>Menu<div>deeper</div></div>",
        "<div style='display: none'>Nothing</div>",
    ],
)
@pytest.mark.parametrize(
    "after", ["", "<section id='comments'><article class='comment'><p>Reader says</p></article></section>", "<footer>&copy; 2020</footer>", "<script>1<2"]
)
def test_extraction_leaves_the_article(before, after):
    assert extraction.main_text(page(before + ARTICLE + after)) == TEXT
    inside = ARTICLE.replace("</article>", before.replace("<header>", "<footer>").replace("</header>", "</footer>") + "</article>")
    assert extraction.main_text(page(inside + after)) == TEXT


def test_extraction_without_marked_article():
    prose = "".join(f"<p>{'Some words of a long paragraph in the main part. ' * 4}</p>" for _ in range(5))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Entry number {i}</a> " for i in range(30)) + "</ul>"
    found = extraction.main_text(page(f"{menu}<div><h2>Short</h2>{prose}</div>{menu}<p>tiny</p>"))
    assert found.count("\n\n") == 5 and found.startswith("Short\n\nSome words") and "Entry" not in found


@pytest.mark.parametrize("container", ["<main>{}</main>", "<div class='post-content'>{}</div>", "<div id=content>{}</div>", "<div role='main'>{}</div>"])
def test_extraction_from_other_containers(container):
    inside = ARTICLE.replace("<article>", "").replace("</article>", "")
    extra = "<div class='menu'><a href='/'>Home</a></div>{}<div id='sidebar'><p>Beside</p></div><div class='comments'><p>Reader</p></div>"
    assert extraction.main_text(page(extra.format(container.format(inside + "<div class='share'>Share</div>")))) == TEXT


@pytest.mark.parametrize("odd", [None, "", "<", "<p", "no markup", "<article>", "<article>a<p", "&#xD800; &amp;&am", "<script>", "<!-- x", "</div></p></article>"])
def test_extraction_of_odd_pages(odd):
    assert isinstance(extraction.main_text(odd), str)


def test_extraction_of_all_pages(spark):
    rows = queries.op5_line_block_extraction(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = re.split(r"<p>|</p>|<h1>|</h1>|<br>", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
        assert r.text == "\n\n".join(b for b in blocks if b)


def without_marks(source):
    """A page whose elements tell nothing: no names or roles, and neutral elements."""
    bare = re.sub(r"\s(class|id|role|itemprop)=(\"[^\"]*\"|'[^']*'|\S+)", "", source)
    return re.sub(r"<(/?)(?:article|main|nav|footer|header|aside|form|section)\b", r"<\1div", bare)


def test_windows_find_the_article_without_marks():
    """By the weights of lines alone the article is whole on every page, and the menu goes on nearly all.

    A menu entry stays where the article's own lines are as short.
    """
    changed = without_menu = 0
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        bare = without_marks(row["html"])
        found = extraction.main_text(bare).split("\n\n")
        expected = extraction.main_text(row["html"]).split("\n\n")
        at = found.index(expected[0])
        assert found[at : at + len(expected)] == expected or set(expected) <= set(found)
        menu = re.findall(r"<li><a [^>]*>([^<]*)", row["html"])
        without_menu += not set(menu) & (set(found) - set(expected))
        changed += len(found) < len([line for line in extraction.Lines(bare).found])
    assert changed == 250 and without_menu >= 240


def plain_regions(weights):
    """Line ranges by definition: from a line of weight on, up to the first window without any."""
    kept = []
    for i in range(len(weights)):
        inside = any(
            weights[s] and all(any(weights[j : j + extraction.WINDOW]) for j in range(s, i + 1)) for s in range(i + 1)
        )
        kept.append(inside)
    return [i for i, k in enumerate(kept) if k]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 40, 200]), max_size=25))
def test_regions_by_definition(weights):
    assert [i for a, b in extraction.regions(weights) for i in range(a, b)] == plain_regions(weights)


def test_extraction_keeps_columns(spark):
    frame = spark.createDataFrame([(1, "<p>" + "word " * 40, "old"), (None, None, None)], "page_id long, html string, TEXT string")
    found = extraction.extracted(frame)
    assert found.columns == ["page_id", "text"]
    assert {r.page_id: r.text for r in found.collect()} == {1: ("word " * 40).strip(), None: ""}
    assert extraction.extracted(frame.limit(0)).collect() == []


LONG = "Some words of a long paragraph in the main part. " * 4


def texts(*parts):
    return "\n\n".join(" ".join(p.split()) for p in parts)


def test_windows_decide_on_marked_pages():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Entry number {i}</a>" for i in range(9)) + "</ul>"
    body = f"<p>{LONG}1<p>{LONG}2"
    found = extraction.main_text(page(f"<div><p>Intro outside the mark</div><article>{body}</article>{menu}<p>x</p><div><p>{LONG}3</div>"))
    assert found == texts("Intro outside the mark", LONG + "1", LONG + "2", "x", LONG + "3")
    # a stub that three lines of links part from the text is no region; one in the mark would be
    assert extraction.main_text(page(f"<article>{body}</article>{menu}<p>x</p>{menu}")) == texts(LONG + "1", LONG + "2")


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<p>One short article.</p>", ["One short article."]),
        ("<p>A short lead.</p><div class=ad>Buy<p>now</div><div id=sidebar><p>Side<p>bar</div>" + f"<p>{LONG}</p>", ["A short lead.", LONG]),
        (f"<p>{LONG}</p><div class=ad>a<p>b<p>c</div><p>A short ending.", [LONG, "A short ending."]),
        (f"<p>{LONG}</p><p><a href=x>The whole paragraph is one link</a></p><p>{LONG}</p>", [LONG, "The whole paragraph is one link", LONG]),
        (f"<p>{LONG}</p><p><a href=x>The last is one link</a></p>", [LONG, "The last is one link"]),
        (f"<p>{LONG}a</p><ul>{''.join(f'<li><a href=/{i}>Part {i}</a>' for i in range(4))}</ul><p>{LONG}b</p>",
         [LONG + "a", "Part 0", "Part 1", "Part 2", "Part 3", LONG + "b"]),
        (f"<h1>Heading</h1><p>{LONG}</p><div class=content><p>{LONG}x</p></div>", ["Heading", LONG, LONG + "x"]),
        (f"<div id=body><p>{LONG}a</div><p>{LONG}b", [LONG + "a", LONG + "b"]),
        (f"<article><p>A card</article><div><p>{LONG}a<p>{LONG}b</div>", ["A card", LONG + "a", LONG + "b"]),
        (f"<main><p>{LONG}a</main><article><p>{LONG}b</article><div class=post><p>{LONG}c</div>", [LONG + "a", LONG + "b", LONG + "c"]),
        (f"<div class='sidebar-layout'><article><p>{LONG}</article></div>", [LONG]),
        (f"<div class='widget page'><p>{LONG}a<p>{LONG}b</div>", [LONG + "a", LONG + "b"]),
    ],
)
def test_extraction_drops_no_article_text(body, expected):
    assert extraction.main_text(page(body)) == texts(*expected)


def test_readers_and_adverts_longer_than_the_article():
    long = f"<p>{LONG}<p>{LONG}"
    for name in ("comments", "ad", "sidebar"):
        assert extraction.main_text(page(f"<article><p>Short</article><div class={name}>{long}</div>")) == "Short"
    assert extraction.main_text(page(f"<p>Short</p><div class=comments>{long}</div>")) == "Short"


# ---- quality


def counts_of(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def check_counts(frame, texts):
    for r in frame.collect():
        expected = counts_of(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == expected, r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 8000").collect()}
    found = queries.op7_adaptive_quality(spark, SF)
    check_counts(found.where(found.doc_id.isin(list(texts))), texts)


def test_counts_and_verdicts_of_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " \n\x0b\f\r", "a a a a a", "a b c a b c a b", "x", "x y", "é日 #$ *|<>&%", "l\nl\n \n\nl \nl", "\x1c \x85 \xa0 a\xa0b"]
    usual = [" ".join(rng.choices([f"word{i}" for i in range(3000)], k=120)) for _ in range(300)]
    junk = [" ".join(f"w{rng.randrange(9999)}$$$%%%" for _ in range(120)), " ".join("x" * 60 + str(i) for i in range(100))]
    rows = dict(enumerate(texts + usual + junk))
    write(spark, documents(rows.items()), tmp_path)
    found = queries.op7_adaptive_quality(spark, str(tmp_path))
    check_counts(found, rows)
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == set(range(len(texts), len(texts) + len(usual)))


def test_limits_follow_the_group(spark):
    """The same rate of symbols is usual in one source and goes in another; a few symbols go nowhere."""
    rng = random.Random(3)

    def text(symbols, words=100):
        found = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        return " ".join(w + "#" * (i < symbols) for i, w in enumerate(found))

    rows = [(i, text(rng.randrange(10, 30)), "en", "code") for i in range(200)]
    rows += [(1000 + i, text(rng.randrange(0, 2)), "en", "news") for i in range(200)]
    rows += [(2000, text(45), "en", "code"), (2001, text(45), "en", "news"), (2002, text(4, 50), "en", "news")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], documents_schema())
    measured = quality.counted(frame)
    kept = {r.doc_id for r in quality.judged(measured).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {2001}
    limits = {r.limit_source: r.m_symbols_most for r in quality.limits_of(measured, "lang", "source", quality.Rules()).collect()}
    exact = sorted(1000 * r.n_symbols // r.n_words for r in measured.where("source = 'code'").collect())
    high, middle = exact[int(len(exact) * 0.9)], exact[len(exact) // 2]
    assert abs(limits["code"] - (high + 4 * (high - middle))) <= (high + 8 * middle) / 32 + 10


def documents_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(text, None, None, 1), (text, None, None, 1), (None, "en", None, 2), (text, "en", "s", None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string, KEPT int")
    found = quality.quality_filter(frame)
    assert found.columns == frame.columns and sorted(str(r.lang) for r in found.collect()) == ["None", "None", "en"]
    assert quality.quality_filter(frame.limit(0)).collect() == []


# ---- URL rules


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def check_urls(frame, urls):
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in frame.collect()} == {i: judged(u) for i, u in urls}


def test_rules_of_all_pages(spark):
    urls = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    check_urls(queries.op8_bloom_url_rules(spark, SF), urls)


def test_rules_of_odd_urls(spark, tmp_path):
    urls = [None, "", "x", "org/", "http://", "://org/", "http://org", "http://org/", "HTTP://A.ORG/x?y#z", "http://example.org/es", "http://www.example.org/es/1"]
    urls += ["http://example.org/en/12", "http://example.org/EN/12", "http://notexample.org/en/1", "https://a.com/fr/", "https://a.com/de/x", "https://com/de/"]
    urls += ["https://a.com?/de/", "https://acom/de/", "https://a.com:80/de/", "a\nb://c.com/de/\nq", "x://" + "a." * 3000 + "org/" + "p" * 5000, "x://É.org/é", "x://y://org/"]
    urls = list(enumerate(urls + urls[4:9]))
    write(spark, [(i, u, None) for i, u in urls], tmp_path, PAGES, "pages")
    check_urls(queries.op8_bloom_url_rules(spark, str(tmp_path)), urls)


def test_many_rules_and_a_crowded_filter(spark, monkeypatch):
    rng = random.Random(2)
    rules = [(f"h{rng.randrange(60)}.net", "/" + "x" * rng.randrange(4), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += [(None, "/", "block"), ("", "/", "block"), ("h1.net", None, "block")]
    urls = [(i, f"http://a.h{rng.randrange(90)}.net/" + "x" * rng.randrange(6)) for i in range(300)]
    frame = spark.createDataFrame(urls, "id long, u string")
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    results = []
    for most in (1, 1 << 18):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
        results.append({r.id: (r.rule, r.verdict) for r in url_filter.judge_urls(frame, table, "u", "block").collect()})
    for i, u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + (p or "")), h + (p or ""), v) for h, p, v in rules if h and host.endswith("." + h) and ("/" + path).startswith(p or "")]
        longest = max(f[0] for f in fits) if fits else None
        verdicts = [f[1:] for f in fits if f[0] == longest]
        assert results[0][i] == results[1][i] == (min(verdicts, key=lambda v: v[1]) if fits else (None, "block"))
    assert url_filter.judge_urls(frame, table.limit(0), "u").where("verdict = 'allow'").count() == 300
    assert url_filter.judge_urls(frame.limit(0), table, "u").collect() == []


# ---- preferences


def example(a, b):
    common = 0
    while common < min(len(a), len(b)) and a[common] == b[common]:
        common += 1

    def render(turns):
        text, spans = "", []
        for role, words in turns:
            start = len(text) + len(f"<|{role}|>\n")
            text += f"<|{role}|>\n{words}<|end|>\n"
            if role == "assistant":
                spans.append((start, len(text)))
        return text, spans

    return (common, render(a[:common])[0], *render(a[common:]), *render(b[common:]))


def test_preferences_of_all_conversations(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    rows = queries.op4_preference_format(spark, SF).collect()
    assert sorted(r.pair_id for r in rows) == sorted({c // 2 for c in turns})
    for r in rows:
        common, prompt, chosen, c_spans, rejected, r_spans = example(turns.get(2 * r.pair_id, []), turns.get(2 * r.pair_id + 1, []))
        masks = [",".join(f"{a}-{b}" for a, b in s) for s in (c_spans, r_spans)]
        assert (r.common_turns, r.prompt, r.chosen, r.rejected, [r.chosen_mask, r.rejected_mask]) == (common, prompt, chosen, rejected, masks)


def test_preferences_of_odd_rows(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "é😀"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, "user", None)]
    rows += [(2, 0, "user", "same"), (3, 0, "user", "same"), (5, None, None, None), (None, 0, "user", "x"), (7, 1, "assistant", ""), (7, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preferences.preference_examples(turns, preferences.neighbours(turns)).collect()}
    assert set(found) == {0, 1, 2, 3}
    first = found[0]
    assert (first.common_turns, first.prompt) == (1, "<|user|>\nq<|end|>\n")
    assert first.chosen == "<|assistant|>\né😀<|end|>\n" and [tuple(s) for s in first.chosen_mask] == [(14, len(first.chosen))]
    assert first.rejected.endswith("<|user|>\n<|end|>\n") and len(first.rejected_mask) == 1
    assert (found[1].common_turns, found[1].chosen, found[1].rejected) == (1, "", "")
    assert (found[2].prompt, found[2].chosen, found[2].rejected) == ("", "", "<||>\n<|end|>\n")
    assert len(found[3].rejected_mask) == 2
    none = turns.limit(0)
    assert preferences.preference_examples(none, preferences.neighbours(none)).collect() == []


def test_paths_come_from_the_tokenizer_package():
    assert queries.PIECE_MODEL == public_tokenizers.path("piece_bpe_32k.model")

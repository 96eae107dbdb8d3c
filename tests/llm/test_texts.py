"""Token counts, line dedup, BPE and HTML: brute force, exact round trips and defined cases."""

import hashlib
import random
import re

import pytest
import public_tokenizers
import tiktoken
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st

from sqltrail.llm import bpe, html_text, line_dedup, queries, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __hashish int, key string"
HARD = ["", None, " ", "\n\n", "a" * 3000, "x  y\n\n z \t", "don't WON'T I'll 's", "\x1c a\x1f\x85b １２ ½é🙂漢字", "ab" * 400 + "!" * 90]


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", None, None, 1, "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("__hashish", "hash")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    coder = bpe.encoder()
    chance = random.Random(5)
    letters = " \n\t'sdtaebcé漢１!?.  \x1c\x85½　"
    texts = HARD + ["".join(chance.choices(letters, k=chance.randint(0, 200))) for _ in range(1500)]
    for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids == reference.encode_ordinary(text or "")
        assert coder.decode_bytes(ids) == (text or "").encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(reference, text):
    assert bpe.encoder().encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("piece", [b"ab", b"abcabcabc" * 20, bytes(range(256)) * 2, b"\x00" * 130])
def test_long_and_short_merges_agree(piece):
    coder = bpe.encoder()
    size = 1 << (len(piece) - 1).bit_length()
    assert coder._merge_long(piece) == coder._merge_short([piece], size)[0]


def test_bpe_cache_overflow(reference):
    coder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, cache_units=5)
    texts = ["one two three", "four five six seven eight nine", "one ten"]
    assert list(coder.encode_batch(texts, at_once=1)) == [reference.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, reference):
    table = docs(spark, HARD + HARD)
    for row, text in zip(bpe.digest(table).orderBy("doc_id").collect(), HARD + HARD, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(table)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(HARD + HARD)}
    assert bpe.digest(table.limit(0)).count() == 0


def test_token_counts(spark, reference):
    texts = HARD + ["one two", "one two", "word " * 3000]
    table = docs(spark, texts)
    lengths = [len(reference.encode_ordinary(t or "")) for t in texts]
    counted = token_counts.count_tokens(table, keep=("lang", "source"))
    hist = token_counts.histogram(counted, ("lang", "source")).cache()
    for row in hist.collect():
        n = row.n_tokens
        assert row.lang == "en" and row.source is None
        assert row.n_docs == lengths.count(n)
        assert row.docs_from == sum(x >= n for x in lengths) and row.tokens_from == sum(x for x in lengths if x >= n)
        assert row.docs_total == len(lengths) and row.tokens_total == sum(lengths)
        assert row.tokens_cut == sum(min(x, n) for x in lengths)
    assert hist.count() == len(set(lengths))
    limits = [0, 1, 3, 100, 2048, 10**9]
    cut = {r.context_limit: r.tokens_cut for r in token_counts.truncated_total(hist, limits, ("lang",)).collect()}
    assert cut == {x: sum(min(y, x) for y in lengths) for x in limits}
    for q in (0.1, 0.5, 1.0):
        need = -(-q * len(lengths) // 1)
        assert token_counts.quantile(hist, q).first().n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= need)
    assert token_counts.report(table.limit(0)).count() == 0
    assert token_counts.report(table.withColumn("lang", table.source)).first().lang is None


def test_token_counts_query(spark, reference):
    rows = queries.queries()["op1_token_counts"](spark, SF).collect()
    lengths = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect():
        lengths.setdefault(d.lang, []).append(len(reference.encode_ordinary(d.text or "")))
    assert {(r.lang, r.n_tokens): r.n_docs for r in rows} == {(k, n): v.count(n) for k, v in lengths.items() for n in v}


def test_token_answers(spark, reference):
    rows = queries.queries()["op1_token_counts"](spark, SF).collect()
    lengths = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect():
        lengths.setdefault(d.lang, []).append(len(reference.encode_ordinary(d.text or "")))
    every = [n for v in lengths.values() for n in v]

    def least(v, share):
        return min(x for x in v if sum(y <= x for y in v) >= -(-share * len(v) // 1))

    for r in rows:
        own = lengths[r.lang]
        assert r.docs_from == sum(x >= r.n_tokens for x in own) and r.tokens_from == sum(x for x in own if x >= r.n_tokens)
        assert r.docs_total == len(own) and r.tokens_total == sum(own) and r.tokens_cut == sum(min(x, r.n_tokens) for x in own)
        for name, v in (("lang", own), ("all", every)):
            assert [r[f"{name}_docs"], r[f"{name}_tokens"]] == [len(v), sum(v)]
            assert [r[f"{name}_p{q}"] for q in (50, 90, 99)] == [least(v, q / 100) for q in (50, 90, 99)]
            assert [r[f"{name}_cut_{x}"] for x in (512, 2048, 8192, 32768)] == [sum(min(y, x) for y in v) for x in (512, 2048, 8192, 32768)]


def test_bpe_registered_query(spark, reference):
    rows = {r.doc_id: r for r in queries.queries()["op6_byte_bpe"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for d in texts:
        ids = reference.encode_ordinary(d.text or "")
        assert tuple(rows[d.doc_id])[1:3] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def brute_lines(rows, least):
    key = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_cases(spark):
    texts = ["Foo \n\nbar", "\tFOO\nbar\n", "foo", None, "", "foo\nfoo\nÀ", "à\nÀ", "x\u00a0\nx", "foo\rbar", "only\nhere\n"] + ["foo\nonce more"] * 3
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None]
    table = docs(spark, texts, ids)
    for least in (1, 2, 3, 4):
        cleaned = line_dedup.clean(table, min_docs=least, length_column="n_chars")
        assert cleaned.columns == [*table.columns, "__n_lines", "__n_dropped"]
        got = sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in cleaned.collect()), key=repr)
        assert got == brute_lines(list(zip(ids, texts, strict=True)), least)
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())
    assert line_dedup.report(table.limit(0)).count() == 0


def test_line_dedup_hot_lines(spark, monkeypatch):
    from sqltrail.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = [f"hot\nown {i}\nhot" for i in range(60)]
    rows = line_dedup.report(docs(spark, texts)).collect()
    assert len(rows) == 60 and all(r.n_dropped == 2 and r.kept_sha256 == hashlib.sha256(f"own {r.doc_id}".encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_url_filters"])
def test_against_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name]) is None


PROSE = "The story of the man and the sea is that it was on the water for a long time with the fish. " * 4
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site of the year</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">{PROSE}</div><div>{PROSE} &amp; <b>bo</b>ld</div>
<p>Short &lt;one&gt;.</p><script>var a = "<p>" + '</p>';</script><div class="comments list"><p>{PROSE}</p></div>
<form><p>{PROSE}</p></form><aside>{PROSE}</aside><p>&copy; 2020 us</p><!-- <p>{PROSE}</p> --><footer>{PROSE}"""


def test_html_without_article():
    prose = PROSE.strip()
    assert html_text.main_text(PAGE).split("\n\n") == [f"{prose} & bold", "Short <one>."]


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "layout-with-header", "share-enabled", "comments-open", "left-sidebar", "page-header"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_hints_at_the_layout(name, inner):
    page = f"<nav>a</nav><div class='{name}'><{inner}><p>{PROSE}</p><div class='ad'>{PROSE}</div></{inner}></div><p>xy</p>"
    assert html_text.main_text(page).split("\n\n")[0] == PROSE.strip() and html_text.main_text(page).count("The story") == 4


def test_html_hints_that_stay():
    for name in ("cookie-notice", "post-comments", "related"):
        assert html_text.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == ""
        assert html_text.main_text(f"<article><p>own</p></article><div class='{name}'><article><p>{PROSE}</p></article></div>") == "own"
    assert html_text.main_text(f"<div class='comments'><article><p>{PROSE}</p></article></div>") == ""


def test_html_article_headers_and_links():
    page = f"<article><header class='entry-header'><h1>Title</h1></header><p>{PROSE}</p><p><a href='x'>A linked paragraph</a></p><footer>f</footer></article>"
    assert html_text.main_text(page) == f"Title\n\n{PROSE.strip()}\n\nA linked paragraph"
    assert html_text.main_text("<article><h2><a href='x'>Linked</a></h2><p>xyz</p></article>") == "Linked\n\nxyz"


def test_html_article_keeps_all_its_blocks():
    page = f"<nav>a</nav><div>{PROSE}</div><article><h1>H</h1><p><b>zz<br>qq<p>1&nbsp; 2\n3<div class='ad'>{PROSE}</div><ul><li><a>l</a></ul><p>xyz</article><footer>{PROSE}</footer>"
    assert html_text.main_text(page) == "H\n\nzz qq\n\n1 2 3\n\nxyz"


FOREIGN = {
    "ja": "昨日は朝から雨が降っていたので、私たちは家で本を読んだ。",
    "ru": "Вчера утром шёл сильный дождь, и мы остались дома читать старые книги.",
    "el": "άλφα βήτα γάμμα δέλτα έψιλον ζήτα ήτα θήτα γιώτα κάππα λάμδα μι νι ξι όμικρον πι ρο σίγμα ταυ ύψιλον φι χι ψι ωμέγα",
    "tr": "Dün sabah yağmur yağdı, evde kaldık ve eski kitapları okuduk, sonra çay içtik.",
    "pl": "Wczoraj rano padał deszcz, zostaliśmy w domu i czytaliśmy stare książki.",
    "ko": "어제 아침에 비가 많이 와서 우리는 집에서 오래된 책을 읽었습니다.",
    "th": "เมื่อวานตอนเช้าฝนตกหนักเราจึงอยู่บ้านอ่านหนังสือเก่า",
    "ar": "هطل المطر صباح أمس فبقينا في البيت وقرأنا كتبا قديمة.",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_html_in_any_language(lang):
    """Sentences apart, and one long paragraph, between menus and links, without ``article``."""
    sentence = FOREIGN[lang]
    around = "<nav><ul><li><a href='/'>1</a></li></ul></nav>{}<div><a href='a'>" + sentence + "</a></div><footer>" + sentence + "</footer>"
    parts = [f"{i} {sentence}" for i in range(10)]
    assert html_text.main_text(around.format("".join(f"<p>{p}</p>" for p in parts))) == "\n\n".join(parts)
    whole = " ".join(parts)
    assert html_text.main_text(around.format(f"<div>{whole}</div>")) == whole
    assert html_text.main_text(around.format(f"<h1>7 8</h1><p>{whole}</p><div class='comments'><p>{whole}</p></div>")) == f"7 8\n\n{whole}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "&", "</p></div>", "<p><b", "a<b>c", "<a href='x", "<br><br><br>"])
def test_html_broken_pages(page):
    assert "<p" not in html_text.main_text(page)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pba!-\"'= &;x", max_size=80))
def test_html_never_fails(page):
    html_text.main_text(page)


def test_html_query(spark):
    rows = {r.page_id: r for r in queries.queries()["op5_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    import html

    for p in pages:  # every page of the table has one article, whose blocks are its headings and paragraphs
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert rows[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url
    table = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" + PROSE, 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id is None, r.n_chars) for r in html_text.extract(table).collect()) == [(False, 0), (False, len(PROSE.strip())), (True, 0)]
    assert html_text.extract(table.limit(0)).count() == 0

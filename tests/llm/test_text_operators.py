"""Tokens, pages, languages and toxicity against libraries, brute force and held-out rows."""

import hashlib
import html.parser
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from ticketscope.llm import bpe, html_text, language, pretokenize, token_counts, token_files, toxicity
from ticketscope.llm.common import shared_folder
from ticketscope.llm.piece_cache import PieceCache

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n a", "it's IT'S 'sx '' 're'll", "12 345é１२ ²", "a　 b \t\r\n", "𝔸💩 é́",
    "<|endoftext|>x<|endoftext|><|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "!" * 70, "ab" * 4000, "x\x00y\x7f",
]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "junk", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")


def fuzz(n, seed=1):
    r = random.Random(seed)
    letters = list("abst relvdm'''  \n\t　 éñ1२!?-<|𝔸\x85́$") + ["the ", "'re", "<|endoftext|>", "    "]
    return ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 30, 300]))) for _ in range(n)]


def test_cuts_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = fuzz(1500) + [t for t in ODD if t]
    found, firsts = pretokenize.pieces(texts)
    for i, text in enumerate(texts):
        assert found[firsts[i]:firsts[i + 1]] == [m.group().encode() for m in pattern.finditer(text)]


def test_composition_is_associative():
    after, compose, _ = pretokenize._functions()
    n = len(after)
    for a in range(n):
        for b in range(n):
            assert (after[compose[a, b]] == after[b][after[a]]).all()
            for c in range(n):
                assert compose[compose[a, b], c] == compose[a, compose[b, c]]


def test_long_texts_are_cut_in_parts_that_fit():
    text = "some words here,  and there\n" * 200
    whole = pretokenize.pieces([text])[0]
    parted = [p for part in pretokenize.parts(text, 100) for p in pretokenize.pieces([part])[0]]
    assert parted == whole and len(list(pretokenize.parts(text, 100))) > 10
    assert list(pretokenize.parts("x" * 500, 100)) == ["x" * 500]


def test_full_cache_gives_the_same_ids():
    small, large = bpe.Encoder(RANKS), bpe.Encoder(RANKS)
    small.cache = PieceCache(small._merged, bits=6)
    for seed in range(5):
        texts = fuzz(60, seed)
        assert all((a == b).all() for a, b in zip(small.encode(texts), large.encode(texts)))


def test_bpe_equals_the_library_and_comes_back(spark):
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )
    texts = ODD + fuzz(300, 3)
    rows = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), RANKS).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = encoding.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_offsets_and_repeated_rows(spark):
    rows = bpe.bpe_encode(documents(spark, ["Hello there", "Hello there", ""], [7, 7, None]), RANKS).collect()
    assert sorted((r.doc_id or 0, tuple(r.ends)) for r in rows) == [(0, ()), (7, (5, 11)), (7, (5, 11))]
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([1, 2]), np.array([1, 9]), RANKS)
    assert bpe.round_trip(documents(spark, []), RANKS).count() == 0


def test_token_counts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(JSON)
    texts = ODD + fuzz(400, 5) + [" ".join(["word"] * 600)]
    rows = {r.doc_id: r for r in token_counts.token_counts(documents(spark, texts), JSON).collect()}
    for i, text in enumerate(texts):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes) == (n, len((text or "").encode()))
        assert rows[i].over_limit == (n > 512)
    assert token_counts.token_counts(documents(spark, []), JSON).count() == 0


def test_token_files_round_trip_and_prune(spark):
    tokenizer = Tokenizer.from_file(JSON)
    texts = ODD + fuzz(200, 7)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    folder = shared_folder(spark) + ".orc"
    token_files.write_token_files(documents(spark, texts, ids), folder, JSON)
    found = token_files.with_start(token_files.read_token_files(spark, folder)).orderBy("doc_id").collect()
    start = 0
    by_id = dict(zip(ids, texts))
    for row in found:
        expected = tokenizer.encode(by_id[row.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (list(row.ids), row.start, row.n_tokens) == (expected, start, len(expected))
        start += len(expected)
    assert len(found) == len(texts)
    some = token_files.read_token_files(spark, folder, [3, 5])
    assert {r.doc_id for r in some.collect()} == {3, 5}
    assert "PushedFilters: [In(doc_id, [3,5])]" in some._jdf.queryExecution().executedPlan().toString()
    sums = {r.doc_id: r.ids_crc32 for r in token_files.with_crc32(token_files.read_token_files(spark, folder)).collect()}
    assert sums == {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found}


def test_pages(spark):
    rows = spark.createDataFrame([
        (1, "u", "<body><nav><a href=/>Home</a></nav><article class='post'><h1>A  title</h1><p>First &amp; best"
                 " paragraph, <b>bold</b>.<p>Second&nbsp;one is longer, it has commas.</article>"
                 "<div class='comments'><div class=comment><p>Nice one, thanks.</p></div></div>"
                 "<footer>&copy; us</footer><script>var a = '</p>';</script>"),
        (2, None, None), (3, "u", ""), (3, "u", "<!-- only <p>this</p>"), (4, "u", "<p"),
    ], "page_id bigint, url string, html string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(rows).collect())
    text = "A title\nFirst & best paragraph, bold.\nSecond one is longer, it has commas."
    assert found == [(1, text, len(text)), (2, "", 0), (3, "", 0), (3, "", 0), (4, "", 0)]
    assert html_text.extract_text(rows.limit(0)).count() == 0


def test_unclosed_elements_hide_no_article():
    def texts(page):
        return [text for _, text, _ in html_text.blocks_of(page)]

    for tag in ("svg", "select", "object", "noscript", "template", "math"):
        assert texts(f"<body><div><{tag}></div><article><p>One.<p>Two.</article></body>") == ["One.", "Two."]
    assert texts("<body><svg><path d=''/><article><p>One.</article><svg><text>x</text></svg>") == ["One."]
    assert texts("<p>a <svg><g><text>x</text></g></svg>b <select><option>y<option>z</select>c</p>") == ["a b c"]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, <object data=f><param name=n>see f</object>.") == [
        "If x=2, see f."]
    assert texts("<p>a<svg><foreignObject><div>x</div></foreignObject></svg>b<p>c<script>d <p>e") == ["ab", "c"]
    assert texts("<table><tr><td>a<template><tr><td>x</td></tr></template>b</td></tr></table>") == ["ab"]
    assert texts("<noscript><div>x</div></noscript><template><p>y</p></template><div>z</div>") == ["z"]


def test_held_out_pages_and_viterbi():
    model = html_text.default_extractor()
    right = total = 0
    for page, labels in html_text.labelled_pages(150, seed=77):
        kept = model.keep(html_text.blocks_of(page))
        right += sum(a == bool(b) for a, b in zip(kept, labels))
        total += len(labels)
    assert right / total > 0.97
    # The best path is found: compare with all label sequences of a short page.
    blocks = html_text.blocks_of(html_text.labelled_pages(1, seed=5)[0][0])[:9]

    def score(path):
        own = sum(
            model._score(b[0]) + sum(model.weights.get(f, 0.0) for f in html_text._text_features(b[1], b[2], i, len(blocks)))
            for i, (b, on) in enumerate(zip(blocks, path)) if on
        )
        return own + sum(model.moves[a][b] for a, b in zip(path, path[1:]))

    paths = [tuple(n >> i & 1 for i in range(len(blocks))) for n in range(1 << len(blocks))]
    assert tuple(map(int, model.keep(blocks))) == max(paths, key=score)


def test_language_of_held_out_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learned(rows)
    found = language.identify(rows, model).join(rows, "doc_id").filter(language.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    odd = language.identify(documents(spark, [None, "", "12 ,. 3", "²", "the of and " * 9, "the of and " * 9]), model)
    found = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in odd.collect())
    assert found == [(0, "und", False), (1, "und", False), (2, "und", False), (3, "und", False),
                     (4, "en", True), (5, "en", True)]
    nothing = language.learned(rows.limit(0))
    assert {r.lang_pred for r in language.identify(rows, nothing).collect()} == {"und"}


def test_blocked_forward_backward_equals_the_plain_one():
    random_ = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], np.zeros((2 << 16, 3), np.float32), random_.normal(size=(3, 3)))
    tagger = language.Tagger(model)
    lengths = np.array([1, 0, 31, 32, 33, 200])
    scores = random_.normal(size=(int(lengths.sum()), 3)) * 3
    found = tagger.posteriors(scores, lengths)
    move = np.exp(model.transitions - model.transitions.max(axis=1, keepdims=True))
    at = 0
    for n in lengths:
        e = np.exp(scores[at:at + n])
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = e[t] * (1 if t == 0 else alpha[t - 1] @ move)
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        plain = alpha * beta
        assert np.allclose(found[at:at + n], plain / plain.sum(axis=1, keepdims=True))
        at += n


def test_code_switched_words_get_their_languages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learned(rows)
    tagger = language.Tagger(model)
    words = ["the", "with", "that", "from", "and", "this"] * 3 + ["der", "und", "nicht", "sich", "auf", "ist"] * 3
    best = tagger.posteriors(tagger.word_scores(words).astype(float), np.array([len(words)])).argmax(axis=1)
    assert [model.languages[i] for i in best] == ["en"] * 18 + ["de"] * 18


def test_folding():
    assert toxicity.fold("1D10T ѕtupіd l0ser p@thetic $cum wörthless") == [
        "idiot", "stupid", "ioser", "pathetic", "scum", "worthiess"
    ]
    assert toxicity.fold("THIS!! 1999 eau$$$ la.") == ["this", "eau", "ia"]


def test_toxicity_of_held_out_rows(spark):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(rows, labels)
    found = toxicity.score_texts(rows, lexicon).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in found]) > 0.93
    odd = toxicity.score_texts(documents(spark, [None, "", "you 1d10t, you m0ron", "hello"]), lexicon).collect()
    scores = {r.doc_id: r.score for r in odd}
    assert scores[0] == scores[1] == scores[3] < 0.5 < scores[2]
    assert not toxicity.learn(rows, labels.limit(0)).weights


def test_signs_at_the_end_of_words():
    assert toxicity.fold("a$$ a$$! hat3, wh0r3. THIS! eau$$$ 5$") == ["ass", "ass", "hate", "whore", "this", "eau"]


def test_rare_toxic_words_enter_with_many_labels(spark):
    r = random.Random(3)
    places = {w: i for i, w in enumerate(["".join(r.choices("bcdfghkmnprstu", k=7)) for _ in range(300)])}
    rows = []
    for i in range(2400):
        words = r.sample(list(places), 12)
        if i % 2:
            words[5] = "qqcommon" if i % 240 > 1 else "zzrarely"
        rows.append((i, " ".join(words), i % 2))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert not set(lexicon.weights) & {f" {w} " for w in places}
    matcher = toxicity.Matcher(lexicon)
    assert matcher.score("you zzrarely thing") > 0.5 > matcher.score("you other thing")


def test_exceptions_cancel_a_match():
    lexicon = toxicity.Lexicon({" trash ": 5.0}, ("trash can",), (-5.0, 4.0, 2.0))
    matcher = toxicity.Matcher(lexicon)
    assert matcher.score("you are trash") > 0.5 > matcher.score("a trash can")
    assert toxicity.Matcher(toxicity.Lexicon({})).score("anything") < 0.5


def test_deep_and_untidy_pages_take_linear_time():
    model = html_text.default_extractor()
    n = 40_000
    pages = ["<div class=a>text " * n, "".join(f"<div class=a{i}>t" for i in range(n)), "<section>" * n + "x</b></nav>" * n,
             "<ul><li><ul>" + "<div>" * n + "<li>x</li>" * n, "<svg><foreignObject>" + "<g>" * n + "<div>x" * n]
    for page in pages:
        start = time.time()
        model.text(page)
        assert time.time() - start < 30


def test_known_words_do_not_change_what_is_kept():
    model = html_text.default_extractor()
    for page, *_ in html_text.labelled_pages(40, seed=9):
        whole, known = html_text.blocks_of(page), html_text.blocks_of(page, model.known)
        assert [b[1:] for b in whole] == [b[1:] for b in known] and model.keep(whole) == model.keep(known)


def naive_hits(lexicon, joined):
    found = {}
    for entry, weight in lexicon.weights.items():
        for start in range(len(joined)):
            if joined.startswith(entry, start) and weight > found.get(start, 0.0):
                found[start] = weight
    for phrase in lexicon.exceptions:
        for start in range(len(joined)):
            if joined.startswith(f" {phrase} ", start):
                inside = range(start, start + len(phrase) + 1)
                found = {place: weight for place, weight in found.items() if place not in inside}
    return found


def test_matching_equals_a_naive_search():
    r = random.Random(5)
    words = ["ab", "abc", "abcd", "abcde", "bcde", "cabcd", "dd", "abcdef"]
    for _ in range(60):
        weights = {f" {w} ": r.uniform(0.5, 3) for w in r.sample(words, 3)}
        weights |= {f" {w[:4]}": r.uniform(0.5, 3) for w in r.sample(words, 2) if len(w) > 4}
        phrases = tuple(" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(2))
        lexicon = toxicity.Lexicon(weights, tuple(dict.fromkeys(phrases)))
        text = r.choices(words, k=r.choice([0, 1, 5, 40]))
        joined, found = toxicity.Matcher(lexicon).hits(text)
        assert joined == f" {' '.join(text)} " and found == naive_hits(lexicon, joined)


class _Naive(html.parser.HTMLParser):
    """The blocks of a well-formed page: text between two tags that are not inline."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.blocks, self.hidden = [], [], 0

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag not in ("a", "b", "em", "span", "script", "style"):
            self.close_block()

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag not in ("a", "b", "em", "span", "script", "style"):
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def made_page(r, depth=0):
    def words(n):
        return " ".join(r.choices(["one", "two,", "three.", "&amp;", "&eacute;t&eacute;", "&#8217;s", "  wide\n", "&lt;p&gt;"], k=n))

    def line():
        inline = [words(r.randint(0, 4)), f"<b>{words(2)}</b>", f"<a href='x>y'>{words(1)}</a>", f"<em>x<span>{words(1)}</span></em>",
                  "<script>if (a < b) { '</p>' }</script>", "<!-- <p>no</p> -->"]
        return "".join(r.choices(inline, k=r.randint(0, 4)))

    made = ""
    for _ in range(r.randint(1, 4)):
        tag = r.choice(["p", "h2", "div", "section", "article", "blockquote", "ul", "table"])
        if tag in ("p", "h2") or depth > 3:
            inside = line()
        elif tag == "ul":
            inside = "".join(f"<li>{line()}</li>" for _ in range(r.randint(0, 3)))
        elif tag == "table":
            inside = "".join(f"<tr><td>{line()}</td><td>{line()}</td></tr>" for _ in range(r.randint(1, 2)))
        else:
            inside = line() + made_page(r, depth + 1) + line()
        made += f"<{tag} class=c{r.randint(0, 3)}>{inside}</{tag}>"
    return made


def test_blocks_equal_a_naive_parser():
    r = random.Random(12)
    for _ in range(300):
        page = f"<html><body>{made_page(r)}</body></html>"
        naive = _Naive()
        naive.feed(page)
        naive.close()
        naive.close_block()
        assert [block[1] for block in html_text.blocks_of(page)] == naive.blocks

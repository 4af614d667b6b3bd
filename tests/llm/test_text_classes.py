"""Toxicity, language ID and page extraction: grammar cases, held-out accuracy and odd inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weftline.llm import html_extraction, language_id, toxicity
from weftline.llm.transducers import Transducer

SF = "/root/testdata/sf0.01"


def test_composition_equals_one_after_the_other():
    first = Transducer({(0, "a"): (1, "b", 1.0), (1, "a"): (0, "c", 0.5)}, {1: 0})
    second = Transducer({(0, "b"): (1, "x", 2.0), (1, "c"): (0, "y", 3.0)})
    both = first.then(second, "abcxy")
    for seed in range(100):
        text = "".join(random.Random(seed).choice("abc") for _ in range(20))
        middle, w1 = first.run(text)
        out, w2 = second.run(middle)
        assert both.run(text) == (out, w1 + w2)


CASES = {
    "you are an idiot": "targeted", "kim is a complete idiot": "framed", "idiot, leave it": "framed", "leave it, idiot": "framed", "what a pathetic, worthless scum": "framed",
    "house of the idiot house": "lone", "they are not an idiot": "negated", "he was never such an idiot": "negated", "the paper reported that he was called an idiot": "reported",
    'he typed "idiot" into it': "reported", "the word idiot is old": "reported",
}


@pytest.mark.parametrize("text,kind", CASES.items())
def test_patterns(text, kind):
    assert {k for k, _ in toxicity.Scorer({}).matches(text)} == {kind}
    assert (toxicity.Scorer({}).score(text)[0] >= 0.5) == (kind in ("targeted", "framed"))


@pytest.mark.parametrize("text,toxic", [("i will kill you", True), ("we will come and hurt them", True), ("he said he will kill you", False), ("never kill them", False),
                                        ("a kind word for all of you", False), ("they kill time", False), ("", False), ("idiom and moronic acid", False)])
def test_threats_and_plain_texts(text, toxic):
    assert (toxicity.Scorer({}).score(text)[0] >= 0.5) == toxic


@pytest.mark.parametrize(
    "part,text",
    [("report", "the paper reported that he is an idiot"), ("negation", "house he is not an idiot house"), ("target", "you house house scumbag house"), ("frame", "kim is a complete idiot"), ("threat", "i will kill you")],
)
def test_each_part_of_the_grammar_decides(part, text):
    """Without the part the decision turns; without any other part it stays."""
    whole = toxicity.Scorer({}).score(text)[0] >= 0.5
    for name in toxicity.parts():
        assert ((toxicity.Scorer({}, name).score(text)[0] >= 0.5) != whole) == (name == part), name


def patterns_by_hand(symbols):
    """What the grammar should find in a clause, by looking around each insult instead of stepping a machine."""
    told = list(symbols)
    for i, s in enumerate(symbols):
        before = "".join(symbols[:i])
        if s in "IH" and "R" in before:
            told[i] = {"I": "r", "H": "O"}[s]
        elif s == "I" and re.search("K[KD]*$", before):
            told[i] = "r"
    out = list(told)
    for i, s in enumerate(told):
        if s in "IH" and re.search("N[NBD]*$", "".join(told[:i])):
            out[i] = {"I": "n", "H": "O"}[s]
    for i, s in enumerate(out):  # a target with at most three other words between
        if s == "I":
            gap = 0
            for k in range(i - 1, -1, -1):
                if out[k] == "Y":
                    out[i] = "T" if gap <= 3 else "I"
                    break
                gap += out[k] not in "IT"
    found, last, text = [], None, "".join(out)
    for i, s in enumerate(out):
        before, after = text[:i], text[i + 1 : i + 2] or "$"
        if s in "nrT":
            found.append({"n": "negated", "r": "reported", "T": "targeted"}[s])
        elif s == "I":
            row = re.search("ID*(VD*)?$", before)
            if row and found[last] == "lone":
                found[last] = "framed"
            address = (re.search("^D*$", before) or re.search("V[DV]*$", before)) and after in "V$"
            last = len(found)
            found.append("framed" if row or address or re.search("B[DB]*O?$", before) else "lone")
    return found


def test_grammar_on_whole_texts_equals_a_plain_reading():
    words = {"I": "idiot", "Y": "you", "N": "never", "D": "the", "B": "is", "V": ",", "K": '"', "R": "said", "O": "house", "H": "kill"}
    scorer, rng, seen = toxicity.Scorer({}), random.Random(11), set()
    for n in range(6000):
        clauses = [[rng.choice("IIIOOOOODDBVVYNRHK"[: 12 if n % 2 else None]) for _ in range(rng.randint(1, 16))] for _ in range(rng.randint(1, 3))]
        text = ". ".join(" ".join(words[s] for s in c) for c in clauses)
        want = [kind for c in clauses for kind in patterns_by_hand(c)]
        assert [kind for kind, _ in scorer.matches(text) if kind != "threat"] == want, clauses
        seen.update(want)
        rest = 1.0
        for kind in want:
            rest *= 1 - 0.7 * toxicity.PRIOR[kind]
        assert abs(scorer.score(text)[0] - (1 - rest)) < 1e-9
    assert seen == {"lone", "framed", "targeted", "negated", "reported"}


def test_clauses_of_thousands_of_words():
    rng = random.Random(3)
    clause = [rng.choice("OOOOOOOODBVIYN") for _ in range(8000)]
    words = {"I": "idiot", "Y": "you", "N": "never", "D": "the", "B": "is", "V": ",", "O": "house"}
    assert [k for k, _ in toxicity.Scorer({}).matches(" ".join(words[s] for s in clause))] == patterns_by_hand(clause)


def test_labels_decide_what_a_lone_insult_weighs(spark):
    rows = [(i, f"{prose(6, i)} zurgle {prose(6, i + 1)}", 1) for i in range(200)] + [(1000 + i, prose(20, i), 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.Scorer(toxicity.learn_stems(docs, docs))
    lone = "house house house zurgle house house"
    assert toxicity.Scorer({"zurgle": 0.99}).score(lone)[0] < 0.5 < scorer.score(lone)[0]
    # what no label speaks of stays as it was
    assert scorer.score("house he said house house the zurgle")[0] < 0.5 and scorer.score("house house is never a zurgle house")[0] < 0.5


def test_stems_are_learned_and_copies_are_not(spark):
    endings = ["ig", "ung", "en", "a", "os"]
    rng = random.Random(1)
    bad = [(i, f"{prose(30, i)} the grumblox{rng.choice(endings)} {prose(10, i + 1)}", 1) for i in range(120)]
    copies = [(1000 + i, "zimzam frotzen quarvel grumbloxig plim", 1) for i in range(40)]
    good = [(2000 + i, prose(40, i + 7), 0) for i in range(400)]
    rows = spark.createDataFrame(bad + copies + good, "doc_id long, text string, toxic int")
    labels = rows.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (2001, None), (99_999, 1)], "doc_id long, toxic int"))
    stems = toxicity.learn_stems(rows.drop("toxic"), labels)
    assert any("grumbloxig".startswith(s) for s in stems) and not any(s.startswith(("zim", "frot", "quar")) for s in stems)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(rows, stems).collect()}
    assert all(got[i] for i, _, _ in bad + copies) and not any(got[i] for i, _, _ in good)
    assert toxicity.learn_stems(rows.limit(0), labels) == {}


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    out = toxicity.score_toxicity(odd_docs, {}).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.score_toxicity(no_docs, {}).count() == 0
    kept = toxicity.drop_toxic(odd_docs, {"ka": 0.9})
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()


def test_held_out_languages_are_predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify(docs, language_id.learn_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert sum(r.rejected for r in out) <= 0.02 * len(out)


def test_held_out_toxicity_is_predicted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, toxicity.learn_stems(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


@pytest.fixture(scope="module")
def languages(spark):
    return language_id.learn_languages(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("n,least_accepted", [(1, 0), (2, 0.02), (3, 0.3), (5, 0.9), (12, 0.95)])
def test_short_texts_are_right_or_rejected(spark, languages, n, least_accepted):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    rows = docs.where(language_id.held_out(F.col("doc_id"))).select("lang", "text").collect()
    cut = [(r.lang, " ".join(found[1 : n + 1])) for r in rows if len(found := language_id.WORD.findall(r.text)) > n]
    encoders = language_id.Encoders(languages)
    best, score, _, accepted = encoders.predict([t for _, t in cut])
    right = [encoders.langs[b] == lang for b, (lang, _) in zip(best, cut, strict=True)]
    n_accepted = int(accepted.sum())
    assert n_accepted >= least_accepted * len(cut)
    assert sum(a and r for a, r in zip(accepted, right, strict=True)) >= 0.93 * n_accepted
    # what is rejected never scores above a half
    assert all(s <= 0.5 for s, a in zip(score, accepted, strict=True) if not a)


def test_languages_that_were_not_learned_are_rejected(spark, languages):
    foreign = ["日本語のテキストはここにあります。とても長い文章です。", "Привет, как дела сегодня? Это очень длинное предложение.", "Danas je lijep dan i idemo zajedno u grad kupiti kruh i mlijeko za obitelj.",
               "Kirjasto on suljettu tänään koska kaikki työntekijät ovat lomalla ja tulevat takaisin maanantaina.", "Dziś jest piękny dzień i idziemy razem do miasta kupić chleb", "Καλημέρα σας, τι κάνετε σήμερα;"]
    docs = spark.createDataFrame(list(enumerate(foreign)) + [(100 + i, t * 40) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert all(r.rejected and r.score <= 0.5 for r in language_id.identify(docs, languages).collect())


def test_sizes_equal_plain_encodings(spark, languages):
    import zstandard

    encoders, texts = language_id.Encoders(languages), ["Thblely sha", prose(30, 1), prose(3000, 2), "x"]
    best, margin, second, gain, bare, size = encoders.measure(texts)
    for k, text in enumerate(texts):
        own = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode()
        n = max(1, min(8, 2048 // len(own)))
        params = zstandard.ZstdCompressionParameters.from_level(6, source_size=4096 + 256, dict_size=65536, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes = []
        for lang in sorted(languages.dictionaries):
            made = zstandard.ZstdCompressionDict(languages.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=params)
            pack = zstandard.ZstdCompressor(compression_params=params, dict_data=made).compress
            before = [language_id.known_text(languages.dictionaries[lang], m) for m in range(n)]
            sizes.append(sum(len(pack(b + own[at : at + 4096])) - len(pack(b)) for b in before for at in range(0, len(own), 4096)) / n)
        order = sorted(sizes)
        assert sizes[best[k]] == order[0] and margin[k] == pytest.approx(order[1] - order[0]) and second[k] == pytest.approx(order[1]) and size[k] == len(own)
        assert gain[k] == pytest.approx(bare[k] - order[0])


def test_languages_on_odd_rows(spark, odd_docs, no_docs):
    learned = language_id.learn_languages(odd_docs)
    assert set(learned.dictionaries) <= {"en", "de", "es", "ja", "fr"}
    out = language_id.identify(odd_docs, learned).collect()
    assert len(out) == odd_docs.count()
    for r in language_id.identify(odd_docs, learned).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.lang_pred == "und") == (not r.text or not r.text.strip()) and 0 <= r.score <= 1
    nothing = language_id.learn_languages(no_docs)
    assert nothing.dictionaries == {}
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, learned).count() == 0
    assert language_id.keep_identified(odd_docs, learned).columns == odd_docs.columns


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "²½ 12 ①"), (2, "² x"), (3, "_"), (4, "日")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.Languages({"en": b" x y z " * 20, "ja": "日本語".encode() * 20})).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und" and got[4] != "und"


def test_all_excerpts_are_in_the_dictionary(spark):
    docs = spark.createDataFrame([(i, prose(400, i) + " ñçé" * 50, "xx") for i in range(900)], "doc_id long, text string, lang string")
    size = len(language_id.language_dictionaries(docs)["xx"])
    assert 0.9 * language_id.DICTIONARY_BYTES <= size <= language_id.DICTIONARY_BYTES


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One,  two.<p>Three &amp; four<br>five</p>"
     '<section class="comments"><p>No</p></section><form><p>No</p></form></article><footer>No</footer></body></html>', "Head\nOne, two.\nThree & four five"),
    ('<body><div id=nav><a>Home</a></div><div class="story"><h2>Head</h2><p>Long text, with words. And more, here there, and so on.</p><p>Short</p><ul><li>one<li>two</ul></div>'
     '<div class=sidebar>Other stuff</div></body>', "Head\nLong text, with words. And more, here there, and so on.\nShort\none\ntwo"),
    ("<p>a < b & c &lt; d</p>", "a < b & c < d"),
    ("plain text only", "plain text only"),
    ('<div class="ad">only ad</div>', ""),
    ("<article></article><p>x", "x"),
    ("<!-- <p>no</p> --><article><p>yes<script>var x = '<p>no</p>';</script></p></article>", "yes"),
    ('<article><p title="a > b">in</p><aside>no</aside><p style="display:none">no</p>', "in"),
    ("", ""),
    (None, ""),
]


def test_pages(spark):
    rows = [(i, None if i % 2 else "u", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>"), (0, "u", PAGES[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extraction.extract_main_text(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    assert {i: got[i] for i in range(len(PAGES))} == {i: w for i, (_, w) in enumerate(PAGES)}
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


STORY = [f"{prose(60, i)}, {prose(9, i + 50)}. {prose(20, i + 90)}, and so on." for i in range(3)]
PARAGRAPHS = "".join(f"<p>{s}</p>" for s in STORY)


@pytest.mark.parametrize(
    "page,blocks",
    [
        ("".join(f"<article class=teaser><h2>Card {i}</h2><p>Read more here</p></article>" for i in range(4)) + f"<div>{PARAGRAPHS}</div>", STORY),
        (f'<article>{PARAGRAPHS}</article><article class="hentry comment"><p>{prose(50, 7)}</p></article><article id="comment-12"><p>{prose(50, 8)}</p></article>', STORY),
        (f"<article><h1>Head</h1><p>{STORY[0]}</p></article><div><p>{STORY[1]}</p><p>{STORY[2]}</p></div>", ["Head", *STORY]),
        (f"<main><section>{PARAGRAPHS}</section><ul><li>Home<li>News<li>Sport<li>Help</ul></main>", STORY),
        (f'<article class="post sponsored"><h1>Head</h1><div>{PARAGRAPHS}<table><tr><td>1</td><td>2</td></tr></table></div></article>', ["Head", *STORY, "1", "2"]),
    ],
    ids=["article teasers", "article comments", "text outside article", "links in main", "table in article"],
)
def test_ratios_decide_within_and_outside_articles(page, blocks):
    assert html_extraction.main_text(f"<html><body>{page}</body></html>").split("\n") == blocks


@pytest.mark.parametrize(
    "page,blocks",
    [
        (f'<div class="content has-sidebar"><article>{PARAGRAPHS}</article></div>', STORY),
        (f'<div id="page" class="with-header"><div>{PARAGRAPHS}</div></div>', STORY),
        (f'<div class="header fixed"><article>{PARAGRAPHS}</article><div class="ad"><p>{prose(40, 5)}</p></div></div>', STORY),
        (f'<form id="aspnet"><div class="social"><div>{PARAGRAPHS}</div></div></form>', STORY),
        (f'<div>{PARAGRAPHS}</div><div class="post-comments"><div><p>{prose(900, 6)}</p></div></div>', STORY),
        (f'<div><p>{STORY[0]} <span class="share">Share</span></p></div><div class="left-sidebar"><div><p>{prose(20, 6)}</p></div></div>', STORY[:1]),
    ],
    ids=["has-sidebar", "with-header", "header around article", "form around page", "long comments", "leaf regions"],
)
def test_names_do_not_cut_what_wraps_the_page(page, blocks):
    assert html_extraction.main_text(f"<html><body>{page}</body></html>").split("\n") == blocks


def test_the_ratios_decide_on_real_pages(monkeypatch):
    import re

    pages = [r[0] for r in __import__("duckdb").sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    texts = [html_extraction.main_text(p) for p in pages]
    # without any names and kinds the ratios alone choose the same on most pages, and keeping all is right on none
    monkeypatch.setattr(html_extraction, "LOW", 1.0)
    alone = [html_extraction.main_text(p) for p in pages]
    assert sum(t == a for t, a in zip(texts, alone, strict=True)) >= 0.9 * len(pages)
    assert all(a != html_extraction.main_text(p, threshold=0.0) for p, a in zip(pages, alone, strict=True))
    monkeypatch.undo()
    # the landmark elements are not what the choice rests on
    bare = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p) for p in pages]
    assert sum(html_extraction.main_text(p) == t for p, t in zip(bare, texts, strict=True)) >= 0.99 * len(pages)
    # the article as a plain reading of the markup gives it
    article = re.compile(r"<article>(.*?)</article>", re.S)
    plain = lambda h: re.sub(r"\s+", "", __import__("html").unescape(re.sub(r"<[^>]+>", " ", h)))
    clean = [(plain(m[1]), re.sub(r"\s+", "", t)) for p, t in zip(pages, texts, strict=True) if (m := article.search(p)) and "<!--" not in m[1] and "class=" not in m[1] and "<script" not in m[1]]
    assert len(clean) > 100 and sum(a == b for a, b in clean) >= 0.99 * len(clean)


def plain_choice(page):
    """The texts of the content nodes, from sums over the page's nodes written out one by one."""
    reader = html_extraction.read_page(page)
    nodes, weight = reader.nodes, reader.weights()
    marks = [sum(c in ".,;:!?…。，、；：！？" for c in n[2]) for n in nodes]

    chosen = [True] * len(nodes)
    for per_node, least in ((False, 0.5), (True, 0.15)):

        def ratio(same, per_node=per_node):
            mine = [k for k in range(len(nodes)) if same(nodes[k])]
            if not mine:
                return 0.0
            chars, each = sum(len(nodes[k][2]) for k in mine), sum(marks[k] for k in mine) / len(mine)
            return (min(chars / len(mine), 200) if per_node else chars) * (1 + min(each, 3))

        own = [ratio(lambda n, p=node[0]: n[0] == p) for node in nodes]
        around = [max(ratio(lambda n, p=p: n[1] == p) for p in (node[1], *node[3])) for node in nodes]
        weighed = [o * w for o, w in zip(own, weight, strict=True)]
        at = lambda k, weighed=weighed: weighed[min(max(k, 0), len(nodes) - 1)]
        smooth = [(at(k - 2) + 2 * at(k - 1) + 4 * at(k) + 2 * at(k + 1) + at(k + 2)) / 10 for k in range(len(nodes))]
        fused = [max((o * s) ** 0.5, a) for o, s, a in zip(own, smooth, around, strict=True)]
        for k in range(len(nodes) - 2, -1, -1):
            if nodes[k][5] and weight[k] == weight[k + 1]:
                fused[k] = max(fused[k], fused[k + 1])
        best = max((f for f, w in zip(fused, weight, strict=True) if w == 1), default=float("inf"))
        chosen = [c and f * w >= least * best for c, f, w in zip(chosen, fused, weight, strict=True)]
    return "\n".join(n[2] for n, c in zip(nodes, chosen, strict=True) if c)


def test_ratios_equal_plain_sums():
    pages = [r[0] for r in __import__("duckdb").sql(f"SELECT html FROM '{SF}/pages.parquet' WHERE html IS NOT NULL").fetchall()] + [p for p, _ in PAGES if p]
    assert all(html_extraction.main_text(p) == plain_choice(p) for p in pages)


def test_names_alone_do_not_decide():
    story = "".join(f"<p>A long sentence, number {i}, with words and more words in it. And another one, too.</p>" for i in range(12))
    links = "<div><span><a>One</a></span><span><a>Two</a></span></div>"
    # what has no name against it, but little text on its paths, goes; a name against most of the page's text doesn't count
    assert html_extraction.main_text(f"<body>{links}<section>{story}</section></body>").count("\n") == 11
    assert "One" not in html_extraction.main_text(f"<body>{links}<section>{story}</section></body>")
    told = html_extraction.main_text(f'<body><div><p>Short.</p></div><ul class="related">{"".join(f"<li>Long text {i}, with marks, and more of it. And so on, and on.</li>" for i in range(60))}</ul></body>')
    assert "Long text 3" in told


def test_deep_nesting_costs_no_more_than_its_length():
    assert html_extraction.main_text("<div>x. " * 50_000).count("\n") == 49_999
    assert html_extraction.main_text("<aside>x. " * 50_000) == ""


def test_long_and_broken_pages():
    assert html_extraction.main_text("<p>" * 20_000 + "x") == "x"
    assert html_extraction.main_text('<a href="' * 3000 + "y") is not None
    text = " ".join(["word"] * 200_000)
    assert html_extraction.main_text(f"<article><p>{text}</p></article>") == text

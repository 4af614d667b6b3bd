"""Near duplicates and decontamination, held against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weftline.llm import decontamination as de
from weftline.llm import near_duplicates as nd
from weftline.llm.components import connected_components


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d is None, d or 0, -1 if d is None else least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, -1 if r.class_id is None else r.class_id, r.n_links) for r in df.collect())


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_join_equals_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(nd, "LEAST_BLOCK", 8)
    base = prose(150, 5)
    rows = [(i, t) for i, t, _ in odd_rows if i != 10]
    rows += [(100 + i, edited(base, i, i % 6)) for i in range(60)] + [(300 + i, prose(30, i % 9)) for i in range(30)] + [(400 + i, f"{base} {prose(i, i)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"grp": F.lit(1), "class_id": F.lit("clash")})
    assert found(nd.near_duplicates(docs)) == brute(rows)
    assert nd.near_duplicates(no_docs).count() == 0
    assert nd.near_duplicates(odd_docs).count() == odd_docs.count()


def test_one_document_of_each_class_stays(spark, odd_docs):
    kept = nd.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 2


def test_texts_of_one_doc_id_are_told_apart(spark):
    a, b, c = prose(60, 21), prose(60, 22), prose(60, 23)
    rows = [(3, a), (5, a), (5, b), (5, c), (7, f"{b} x"), (8, f"{c} x"), (9, prose(60, 24)), (5, b), (None, a), (None, a), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == brute(rows)
    kept = Counter((r.doc_id, r.text) for r in nd.drop_duplicates(docs).collect())
    assert kept == Counter([(3, a), (5, b), (5, c), (9, prose(60, 24)), (None, a), (None, a), (None, None), (None, None)])


def test_rows_of_one_class_leave_the_same_row_always(spark):
    a, near, other = prose(60, 41), prose(60, 41) + " more", prose(60, 42)
    rows = [(3, a, "en", None), (3, a, "de", 1), (3, a, "de", 1), (3, near, "fr", 2), (4, near, "en", 3), (3, other, "en", None), (9, "", "en", None), (9, "", None, None), (None, a, "en", 1), (None, a, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    kept = [Counter(map(tuple, nd.drop_duplicates(docs.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1]
    own = [r for r in kept[0] if r[0] is not None]
    # one row of the class of a, one of the other text, one without words; rows without an id stay
    assert len(own) == 3 and {(r[0], r[1]) for r in own} in ({(3, t), (3, other), (9, "")} for t in (a, near)) and set(own) <= set(rows)
    assert kept[0][None, a, "en", 1] == 2


def test_chains_and_stars_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAST_BLOCK", 8)
    monkeypatch.setattr(nd, "BLOCK_CHARS", 4000)
    words = prose(500, 31).split()
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(120)]  # each is linked with its neighbours alone
    base = prose(80, 32)
    rows += [(1000 + i, edited(base, i, i % 4)) for i in range(90)] + [(2000, base), (2001, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == brute(rows)


def test_hot_keys_are_looked_up_like_others(spark, monkeypatch):
    from weftline.llm import components

    monkeypatch.setattr(components, "LEAST_HOT", 5)
    rows = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    values = rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    got = {(r.u, r.v, r.m) for r in components.look_up(rows, values, "u", 200).collect()}
    assert got == {(0, i, 0) for i in range(150)} | {(i, i, i) for i in range(150, 200)}


@pytest.mark.parametrize("size", [20, 60, 200, 1000])
def test_recall_on_whole_texts(spark, size):
    """Pairs of texts a little over the threshold, at several lengths: the bands must bring nearly all together."""
    rng, rows = random.Random(size), []
    for i in range(200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        other = words[: size - size // 12] + [f"v{rng.randrange(10**9)}" for _ in range(size // 12)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    true = {i for i in range(0, 400, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])}
    got = {r.class_id for r in nd.near_duplicates(docs).where("n_links > 0").collect()}
    assert got <= true and len(got) >= 0.99 * len(true) and len(true) >= 190


def test_bands_find_pairs_at_the_threshold():
    hits = 0
    rng = random.Random(2)
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(80)]
        import numpy as np

        a, b = (np.array(sorted(common + [rng.getrandbits(64) for _ in range(10)]), np.uint64) for _ in range(2))
        hits += bool(set(nd.band_keys(a).tolist()) & set(nd.band_keys(b).tolist()))
    assert hits >= 299


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)] + [(2000, 3000 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    least = {}
    for x in parent:
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[find(x)] for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_stay_short(spark, monkeypatch):
    """What the driver holds of a step: plans that don't grow from step to step, and no step for what are stars already."""
    from weftline.llm import components

    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    steps = []
    monkeypatch.setattr(components, "materialize", lambda df, name, write=components.materialize: steps.append((name, leaves(df))) or write(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert len(steps) > 6 and max(n for _, n in steps) <= 8, steps
    steps.clear()
    star = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51), (60, 60)], "a long, b long")
    assert {r.node: r.component for r in connected_components(star).collect()} == dict.fromkeys(range(1, 40), 1) | {50: 50, 51: 50, 60: 60}
    assert len(steps) == 2, steps
    base = prose(80, 51)
    docs = spark.createDataFrame([(i, edited(base, i, i % 3)) for i in range(20)], "doc_id long, text string")
    assert leaves(nd.near_duplicates(docs)) <= 8


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abcd", max_size=120))
def test_bit_parallel_distance(pattern, text):
    want = distance(pattern, text)
    got = de.Pattern(pattern).best(text, len(pattern))
    assert got is None and want >= len(pattern) or got[0] == want and distance(pattern, text[: got[1]]) == want


@pytest.mark.parametrize("errors", [0.0, 0.05, 0.08])
def test_matching_equals_brute_force(errors):
    rng = random.Random(4)
    items = [(i, prose(rng.randint(8, 30), 100 + i).upper()) for i in range(12)]
    matcher = de.Matcher(items, errors)
    for seed in range(60):
        item = items[seed % 12][1]
        text = list(item.lower())
        for _ in range(rng.randint(0, 14)):
            text[rng.randrange(len(text))] = rng.choice("abcx ")
        text = f"{prose(15, seed)} {''.join(text)} {prose(15, seed + 1)}"
        want = {i for i, t in items if distance(de.normal(t), de.normal(text)) <= de.budget(len(de.normal(t)), errors)}
        assert {matcher.items[k][0] for k, _, _, _ in matcher.find(text)} == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=60), st.text("abc ", max_size=80), st.integers(0, 12))
def test_tiles_rule_out_no_match(pattern, text, most):
    assert de.Pattern(pattern).near(text, most) or distance(pattern, text) > most


def test_few_windows_need_a_distance(monkeypatch):
    items = [(i, prose(30, 100 + i)) for i in range(20)]
    calls, best = [], de.Pattern.best
    monkeypatch.setattr(de.Pattern, "best", lambda *own: calls.append(0) or best(*own))
    matcher = de.Matcher(items)
    # a piece of an item each, amid other text made of the same words
    pieces = [piece for _, n in matcher.items for _, piece in de.pieces(n)]
    text = " ".join(f"{prose(30, 900 + k)} {piece}" for k, piece in enumerate(pieces))
    assert not matcher.find(text) and len(calls) < len(pieces) / 5


def test_items_glued_to_other_words_and_short_items():
    glued = de.Matcher([(1, "aa bb cc dd ee")], 0.08)
    assert [m[1] for m in glued.find("xxaa bb cx dd eeyy")] == [1]
    short = de.Matcher([(1, "in"), (2, "a thing or")], 0.08)
    assert not short.find("nothing within a thingy or two") and [short.items[m[0]][0] for m in short.find("it is IN a box")] == [1]
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(4, 9)))) for i in range(20)]
    matcher = de.Matcher(items, 0.1)
    for _ in range(300):
        text = list("x" * rng.randint(0, 3) + items[rng.randrange(20)][1] + "y" * rng.randint(0, 3))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", " ", ""])
        text = de.normal("".join(text))
        want = {i for i, t in items if de.budget(len(t), 0.1) and distance(t, text) <= de.budget(len(t), 0.1)}
        assert {matcher.items[m[0]][0] for m in matcher.find(text)} == want | {i for i, t in items if not de.budget(len(t), 0.1) and f" {t} " in f" {text} "}


def test_leaks(spark, odd_docs, no_docs, monkeypatch):
    items = [(1, prose(20, 1)), (2, "Ünïcode straße, test: of WORDS and more words"), (3, None), (4, ""), (5, "?!"), (None, prose(25, 77)), (1, prose(20, 1))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, f"pre {items[1][1].lower()} post"), (2, prose(300, 50)), (3, f"{prose(10, 2)}\n{items[5][1]}"), (4, None), (5, ""), (None, prose(20, 1))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r for r in de.find_leaks(docs, benchmark).collect()}
    assert set(got) == {(1, 2), (3, None), (None, 1)}
    r = got[1, 2]
    assert texts[0][1][r.start : r.end] == items[1][1].lower() and r.distance == 0
    assert sorted(r.doc_id for r in de.drop_leaks(docs, benchmark).collect()) == [2, 4, 5]
    monkeypatch.setattr(de, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in de.find_leaks(docs, benchmark).collect()} == set(got)
    assert de.drop_leaks(docs, benchmark).columns == docs.columns and de.drop_leaks(docs, benchmark).count() == 3
    assert de.find_leaks(no_docs, benchmark).count() == 0 and de.find_leaks(odd_docs, benchmark.limit(0)).count() == 0

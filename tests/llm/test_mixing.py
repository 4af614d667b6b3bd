"""Mixing: targets and draws against plain Python, and what the rounding guarantees."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weftline.llm import mixing
from weftline.llm.queries import QUERIES


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Source to target, by sharing again and again in exact numbers."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped, left = {}, set(order)
    while left:
        share = Fraction(sum(sizes.values()) - sum(stopped.values()), sum(weight[s] for s in left))
        over = [s for s in left if 3 * sizes[s] <= share * weight[s]]
        if not over:
            return stopped | {s: share * weight[s] for s in left}
        stopped |= {s: Fraction(3 * sizes[s]) for s in over}
        left -= set(over)
    return stopped


def signed_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return h - (1 << 64) if h >> 63 else h


def long(v):
    return None if v is None else struct.pack("<q", v)


def plain_source(own, copies, out, uniform):
    """Appends the results of one source's documents, and returns what the last open one is rounded by."""
    base, groups, level = math.floor(copies), -(-len(own) // mixing.FAN_IN), defaultdict(list)
    close = lambda d: not mixing.CLOSE * d[0] < d[3] < (1 - mixing.CLOSE) * d[0]
    take = lambda d: out.append((d[2], d[0], d[0] * (base + (d[0] > 0 and d[3] >= (1 - mixing.CLOSE) * d[0]))))
    for d, n, draw in own:
        one = (n, draw, d, (copies - base) * n)
        if close(one):
            take(one)
        else:
            level[signed_hash(long(draw)) % groups].append(one)
    while True:
        above = defaultdict(list)
        for g, members in level.items():
            hand = None
            for one in sorted(members, key=lambda d: (-d[0], d[1])):
                if hand is None:
                    hand = one
                    continue
                there, back = min(hand[3], one[0] - one[3]), min(one[3], hand[0] - hand[3])
                step = -there if uniform(hand[1], one[1]) * (there + back) < back else back
                both, hand = [(*hand[:3], hand[3] + step), (*one[:3], one[3] - step)], None
                for d in both:
                    if close(d):
                        take(d)
                    else:
                        hand = d
            if hand:
                above[g // mixing.FAN_IN].append(hand)
        level = above
        if groups <= 1:
            break
        groups = -(-groups // mixing.FAN_IN)
    owed = 0.0
    for d in level[0]:
        more = uniform(d[1]) * d[0] < d[3]
        out.append((d[2], d[0], d[0] * (base + more)))
        owed = d[3] - d[0] * more
    return owed


def plain_mix(rows):
    """Counter of (doc_id, size, taken): the tree of groups, one document after the other."""
    rows = [(d, n_words(t), s) for d, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    targets, seed, out, seen = plain_targets(dict(sizes)), struct.pack("<i", mixing.SEED), [], Counter()
    uniform = lambda *d: ((signed_hash(*map(long, d), seed) & (1 << 64) - 1) >> 11) / (1 << 53)
    for source in sizes:
        key = "none" if source is None else "=" + source
        copies, own, owed = float(targets[source]) / sizes[source] if sizes[source] else 0.0, [(d, n) for d, n, s in rows if s == source], 0.0
        classes = defaultdict(int)
        for _, n in own:
            classes[max(1, n.bit_length())] += n
        up_to = lambda c, classes=classes: sum(n for k, n in classes.items() if k <= c)
        small = min(c for c in classes if up_to(c) * mixing.SMALL >= sizes[source])
        numbered = []
        for d, n in own:
            seen[key, d, n] += 1
            numbered.append((d, n, signed_hash(key, long(d), long(n), long(seen[key, d, n]), seed)))
        for is_small in (False, True):
            some = [x for x in numbered if (max(1, x[1].bit_length()) <= small) == is_small]
            if is_small:
                copies = max(0.0, min(3.0, copies + owed / up_to(small))) if up_to(small) else 0.0
            owed = plain_source(some, copies, out, uniform)
    return Counter(out)


def corpus(n, seed):
    names = ["b", "a", "ä", "Z", None, "", "\U0001f642", "￮"]
    return [(i, prose(1 + (i * 7919 + seed) % 60, i) if i % 11 else None, names[min(int((i * 31 % 97) ** 0.5), 7)] if i % 5 else "b") for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 40, 900])
def test_equals_plain_rounding(spark, n):
    rows = corpus(n, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"key": F.lit("clash"), "groups": F.lit(1), "size": F.lit("x")})
    got = mixing.mix(docs.repartition(5)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    targets, source = plain_targets(dict(sizes)), {d: s for d, _, s in rows}
    assert {r.doc_id: (r.source_size, pytest.approx(float(targets[source[r.doc_id]]))) for r in got} == {r.doc_id: (sizes[source[r.doc_id]], r.target) for r in got}
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == plain_mix(rows)


def test_sources_meet_their_targets_and_reruns_agree(spark):
    folder = "/root/testdata/sf0.1"
    out = QUERIES["op12_mixing"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source")
    rows = out.join(docs, "doc_id").groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert len(rows) == 20 and out.count() == docs.count()
    assert all(abs(r.taken - r.target) <= min(r.largest, 0.01 * r.target) for r in rows), rows
    assert sum(r.target for r in rows) == pytest.approx(sum(r.source_size for r in rows))
    assert out.where("taken > 3 * size or taken % size <> 0").count() == 0
    again = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet").repartition(13))
    assert out.exceptAll(again).isEmpty()


def test_each_document_keeps_its_probability(spark, monkeypatch):
    rows = [(i, prose(n, i), s) for s in "ab" for i, n in ((k + ord(s) * 100, 1 + k % 5) for k in range(8))]
    share = {"a": (1 / 3) * 2, "b": (2 / 3) * 2}
    seen = Counter()
    for seed in range(60):
        monkeypatch.setattr(mixing, "SEED", 1000 + seed)
        for (d, n, taken), _ in plain_mix(rows).items():
            seen[d] += taken / n
    for d, _, s in rows:
        assert abs(seen[d] / 60 - share[s]) < 0.27  # four standard deviations


def test_odd_rows(spark, odd_rows, odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, n_words(t)) for d, t, _ in odd_rows)
    assert all(r.taken == r.size and r.target == r.source_size for r in out)  # one source gets all it has
    assert mixing.mix(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix(nothing).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_main_path_is_native(spark, odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

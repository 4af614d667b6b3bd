"""License scans and quality rules: DataFrame functions only, held against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weftline.llm import license_scan, quality_rules


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_license_scan_finds_whole_and_edited_notices(spark, odd_docs, no_docs):
    long_text = next(t for name, part, t in license_scan.TEMPLATES if name == "Apache-2.0" and part == "header")
    edited = long_text.replace("applicable", "any")
    rows = [(1, f"{prose(50, 1)}\nReleased under the MIT License.\n{prose(50, 2)}"), (2, "released  UNDER the: mit license"), (3, "Released under some license"),
            (4, f"{prose(30, 3)} {edited}"), (5, prose(500, 4)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit("clash"))
    out = license_scan.scan_licenses(docs)
    assert not re.search("Python|Arrow|Pandas", plan(out))
    got = {(r.doc_id, r.license): r for r in out.collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (4, "Apache-2.0")}
    assert got[1, "MIT"].containment == 1.0 and 0.8 <= got[4, "Apache-2.0"].containment < 1
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert license_scan.scan_licenses(odd_docs).count() == 0
    assert license_scan.collision_probability(1) > 0.9998


def test_license_bands_meet_every_notice_at_any_place(spark):
    rows = [(i, f"{prose(i, i)} {t}") for i, (_, _, t) in enumerate(license_scan.TEMPLATES)] + [(100 + i, f"{prose(i + 1, i)} {t} {prose(9, i)}") for i, (_, _, t) in enumerate(license_scan.TEMPLATES)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    exact = {(r.doc_id, r.license) for r in got.where("containment = 1").collect()}
    for i, (name, _, _) in enumerate(license_scan.TEMPLATES):
        assert {(i, name), (100 + i, name)} <= exact


def test_license_bands_keep_their_guarantee(spark):
    one = F.array(*(F.xxhash64("id", F.lit(i)) for i in range(license_scan.WINDOW)))
    rows = spark.range(100_000).select(license_scan.bands(F.slice(one, 1, 1)).alias("a"), license_scan.bands(one).alias("b"))
    missed = rows.where(~F.exists(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same)).count()
    assert missed <= 2 * 100_000 * (1 - license_scan.collision_probability(1))


def test_license_guarantee_holds_at_every_place(spark):
    hashes = F.sequence(F.lit(0), F.col("id") - 1)
    rows = spark.range(1, 15).select("id", license_scan.windows(hashes, license_scan.STRIDE).alias("windows"), license_scan.end_windows(hashes).alias("ends")).collect()
    for n, found, ends in rows:
        assert [0] in found + ends and [n - 1] in found + ends
        for size in range(1, n + 1):
            for start in range(n - size + 1):
                own = [set(range(i, i + min(size, license_scan.WINDOW))) for i in range(start, start + max(1, size - license_scan.WINDOW + 1))]
                best = max(len(o & set(w)) / len(o | set(w)) for o in own for w in found)
                assert 1 - (1 - best) ** license_scan.BANDS >= license_scan.collision_probability(size)


def test_license_notices_of_one_shingle_are_found_at_both_ends(spark):
    notice = "Released under the MIT License."
    rows = [(i, f"{notice} {prose(20 + i % 2, i)}" if i % 4 < 2 else f"{prose(20 + i % 2, i)} {notice}") for i in range(4000)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.where("license = 'MIT'").collect()} == set(range(4000))


def base_of(text):
    text = text or ""
    found = words_of(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_features_equal_plain_python(spark, odd_docs, no_docs):
    extra = [(20, "a b c d e a b c d e f", None), (21, "x\nx\nx\n\n\ny", "en"), (22, "a a a a a a a", "en"), (23, "# * $ %|<>&", "en"), (24, prose(40, 9) + "\n" + prose(40, 9), "en")]
    docs = odd_docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = quality_rules.features(docs)
    assert not re.search("Python|Arrow|Pandas", plan(rows))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows.collect())
    assert got == Counter((r.doc_id, *base_of(r.text)) for r in docs.collect())
    assert quality_rules.features(no_docs).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.05), (7, 2000, 0.01), (300, 40000, 0.01)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("p")).first().p
        assert math.isclose(got, want, rel_tol=1e-6)


def test_cutoffs_limit_false_rejections(spark, no_docs):
    good = [(i, prose(60, i % 7) + f" w{i}", "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(w + "###" for w in prose(60, i).split()), "en") for i in range(200)]
    few = [(9000 + i, prose(60, i) + " ###", "xx") for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 5000 or i >= 9000)) for i, _, _ in good + bad + few] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert sum(not kept[i] for i, _, _ in good) <= quality_rules.RISK * len(good)
    assert not any(kept[i] for i, _, _ in bad)
    assert all(kept[i] for i, _, _ in few), "too few labels to be sure of any cutoff"
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(no_docs, none).count() == 0


def test_audit_rows_confirm_the_statement(spark):
    good = [(i, prose(60, i % 7) + f" w{i}", "en") for i in range(4000)]
    bad = [(9000 + i, " ".join(w + "###" for w in prose(60, i).split()), "en") for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 9000)) for i, _, _ in good + bad], "doc_id long, quality int")
    rows = quality_rules.features(docs)
    cutoffs = quality_rules.choose_cutoffs(rows, labels)
    report = quality_rules.audit(rows, labels, cutoffs)
    assert not re.search("Python|Arrow|Pandas", plan(report))
    r = report.first()
    passed = {i for i, t, _ in good if base_of(t)[0] >= 10 and 100 * base_of(t)[4] <= 20 * base_of(t)[0]}
    unseen = [i for i in passed if i % quality_rules.FOLDS == quality_rules.AUDIT]
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert r.n == len(unseen) and r.n_rejected == sum(i not in kept for i in unseen) <= quality_rules.RISK * r.n
    want = sum(math.comb(r.n, i) * quality_rules.RISK**i * (1 - quality_rules.RISK) ** (r.n - i) for i in range(r.n_rejected + 1))
    assert math.isclose(r.p_value, want, rel_tol=1e-6) and r.confirmed == (want <= quality_rules.ERROR)
    # cutoffs that weren't chosen but made up don't pass
    wild = cutoffs.withColumn("cut_long_words", F.lit(1))
    assert not quality_rules.audit(rows, labels, wild).first().confirmed

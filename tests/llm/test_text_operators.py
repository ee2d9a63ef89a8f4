"""Quality rules, line dedup, sharding, licenses: brute force on small inputs and edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import license_scan, line_dedup, quality_rules, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd_docs, docs):
    for frame in (odd_docs, docs.limit(60)):
        out = quality_rules.apply_quality_rules(frame)
        got = Counter((r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in out.collect())
        assert got == Counter((r["doc_id"], *counts(r["text"])) for r in frame.collect())


def test_host_verdicts(spark):
    rows = [(f"h{h}", i < bad) for h, bad, n in ((1, 95, 100), (2, 5, 100), (3, 1, 1), (4, 0, 100)) for i in range(n)] + [(None, True)]
    out = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), "host").collect()}
    assert set(out) == {"h1", "h2", "h3", "h4"} and out["h1"]["host_rejected"] and not out["h2"]["host_rejected"]
    assert out["h3"]["host_rate"] < 0.95  # one failure of one document is drawn towards the corpus


def test_bad_host_loses_good_documents(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(i, "short" if i < 60 else text, "bad") for i in range(61)] + [(100 + i, text, f"good{i % 3}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good_documents(frame).collect()}
    assert kept == {100 + i for i in range(60)}


def test_quality_keeps_columns(odd_docs, no_docs):
    kept = quality_rules.keep_good_documents(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 9, 10}
    assert quality_rules.keep_good_documents(no_docs).count() == 0 and quality_rules.apply_quality_rules(no_docs).count() == 0


def drop_lines(rows, min_docs, min_chars=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, ls in split for k in {key(x) for x in ls} if len(k) >= min_chars)
    return Counter((i, len(ls), sum(n[key(x)] >= min_docs for x in ls), "\n".join(x for x in ls if n[key(x)] < min_docs)) for i, ls in split)


@pytest.mark.parametrize(("batches", "fan_out"), [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, odd_docs, batches, fan_out):
    rows = [(i, f"  ÉCOLE Same LINE \n{i}\n\nown {i % 7}\r\nsame line\x1c") for i in range(40)] + [(100 + i, "same line\x1c\néCOLE same line") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for f, m in ((frame, 5), (frame, 30), (frame, 44), (odd_docs.select("doc_id", "text"), 2)):
        out = line_dedup.drop_common_lines(f, min_docs=m, batches=batches, fan_out=fan_out)
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())
        assert got == drop_lines([(r["doc_id"], r["text"]) for r in f.collect()], m)


def test_line_runs_take_later_batches(spark):
    """Batches of counted keys, added one by one, settle as one count over all of them does."""
    import random

    rng, runs, whole = random.Random(3), line_dedup.LineRuns(spark, min_docs=6, fan_out=2), Counter()
    for _ in range(5):
        batch = Counter(rng.choices(range(60), k=40))
        whole.update(batch)
        runs.add(runs.stored(spark.createDataFrame(list(batch.items()), "h long, n_docs long").selectExpr("h", "cast(h % 3 as int) as g", "n_docs")))
        assert {r["h"] for r in runs.common_keys().collect()} == {h for h, n in whole.items() if n >= 6}
        assert runs.common_keys().count() == runs.common_keys().distinct().count()
    assert sum(len(level) for level in runs.levels) == 2  # 5 batches at a fan-out of 2: runs on levels 0 and 2


def test_runs_are_saved_and_taken_up_again(spark):
    import random
    from collections import Counter

    rng, whole = random.Random(8), Counter()
    first, name = line_dedup.LineRuns(spark, min_docs=5, fan_out=2), "kept_lines"
    for turn in range(6):
        batch = Counter(rng.choices(range(60), k=50))
        whole += batch
        runs = first if turn < 3 else line_dedup.LineRuns.restored(spark, name, min_docs=5, fan_out=2)
        runs.add(runs.stored(spark.createDataFrame([(h, 0, n) for h, n in batch.items()], "h long, g int, n_docs long")))
        assert {(r["h"], r["n_docs"]) for r in runs.common_counts().collect()} == {(h, n) for h, n in whole.items() if n >= 5}
        if turn >= 2:
            if turn > 2:
                name = f"kept_lines_{turn}"
            runs.saved(name)


def test_line_runs_merge_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    one, two = (runs.stored(spark.range(k, 100 + k).selectExpr("id as h", "0 as g", "id % 4 as n_docs")) for k in (0, 50))
    plan = one.hint("merge").join(two.select("h", "g"), ["h", "g"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_clashing_columns_stay(spark):
    frame = spark.createDataFrame([(i, "common\nown", 7, "x") for i in range(12)], "doc_id long, text string, n_lines int, n_dropped string")
    out = line_dedup.keep_own_lines(frame)
    assert out.columns == frame.columns and {tuple(r)[1:] for r in out.collect()} == {("", 7, "x")}


def test_line_dedup_empty(no_docs):
    out = line_dedup.drop_common_lines(no_docs)
    assert out.count() == 0 and out.columns == [*no_docs.columns, "n_lines", "n_dropped"]


def test_sharding_fits_and_splits_only_when_needed(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 40 as int))").alias("text"))
    out = sharding.assign_shards(rows, limit=900).collect()
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in range(500)}
    prefixes = {}
    for r in out:
        prefixes.setdefault(bits[r["doc_id"]][: r["depth"]], 0)
        prefixes[bits[r["doc_id"]][: r["depth"]]] += r["bytes"]
    assert len(out) == 500 and max(prefixes.values()) <= 900
    for p in prefixes:  # its parent was too large
        assert sum(i % 40 for i in range(500) if bits[i].startswith(p[:-1])) > 900


def test_sharding_hot_and_large(spark, odd_docs, no_docs):
    hot = spark.range(200).select(F.lit(7).alias("doc_id"), F.lit("y" * 50).alias("text")).union(spark.createDataFrame([(1, "z" * 5000), (None, None)], "doc_id int, text string"))
    out = sharding.assign_shards(hot, limit=1000).groupBy("shard_id").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count(F.lit(1)).alias("n"), F.max("shard_docs").alias("d")).collect()
    assert sum(r["n"] for r in out) == 202 and all(r["b"] == r["s"] and r["n"] == r["d"] for r in out)
    assert [r["b"] for r in out if r["b"] > 1000] == [5000]
    assert sharding.assign_shards(odd_docs).count() == odd_docs.count() and sharding.assign_shards(no_docs).count() == 0


def test_shards_do_not_follow_the_partitioning(spark):
    rows = [(7, "y" * 50)] * 200 + [(7, "z" * 40)] * 3 + [(1, "z" * 5000)] * 2 + [(i, "w" * i) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    got = [Counter(tuple(r) for r in sharding.assign_shards(frame.repartition(n), limit=1000).collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(rows)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14), st.lists(st.integers(0, 8), max_size=14))
def test_patience_alignment(a, b):
    pairs = license_scan.patience_align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == longest_common(a, b)  # all common words are anchors
    assert len(license_scan.patience_align(a, a)) == len(a)


@given(st.lists(st.integers(0, 20), max_size=20))
def test_longest_increasing(values):
    picked = [values[i] for i in license_scan.longest_increasing(values)]
    best = 0
    lengths = []
    for i, v in enumerate(values):
        lengths.append(1 + max([lengths[j] for j in range(i) if values[j] < v], default=0))
        best = max(best, lengths[-1])
    assert len(picked) == best and picked == sorted(set(picked))


def test_licenses(spark, odd_docs, no_docs):
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.replace("free of charge", "without fee").replace("sublicense,", "")
    rows = [(1, "one two\nReleased under the MIT license.\nthree"), (2, f"{'a b c ' * 50}\n{changed}\nmore"), (3, "the license version under"), (4, None), (5, mit.replace(" ", "\n"))]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[1]["license"] == "mit-line" and (out[1]["first_word"], out[1]["last_word"]) == (2, 6)
    assert out[2]["license"] == "mit" and 0.9 < out[2]["coverage"] < 1 and out[2]["first_word"] == 150
    assert out[3]["license"] is None and out[4]["license"] is None and out[5]["coverage"] == 1
    assert license_scan.scan_licenses(odd_docs).count() == odd_docs.count() and license_scan.scan_licenses(no_docs).count() == 0


def test_license_prefilter_loses_nothing(docs):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.MIN_COVERAGE)
    out = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        words = [license_scan.core(w) for w in r["text"].encode().split()]
        stated = any(words[i : i + len(t)] == t for t in scanner.words for i in range(len(words)))
        assert (out[r["doc_id"]] is not None) >= stated

"""License scans: statements anywhere in a text, and a brute-force scan."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tidewater.llm import license_scan
from tidewater.llm.license_scan import MIN_COVERAGE, MIN_DENSITY, TEMPLATES, WIDER, Scanner, core, patience_align

MIT = TEMPLATES["mit"]


def spread(text, extra):
    return " ".join(f"{w} {extra}" for w in text.split())


CASES = {
    "after many of its words": " ".join(random.Random(1).choices(MIT.split(), k=800)) + " " + MIT, "after a common word": "the " * 200 + MIT,
    "with two words after each": spread(MIT, "zzz yyy"), "between words of its own": spread(MIT, "the"), "in a long line": "word " * 5000 + MIT + " word" * 5000,
    "before many of its words": MIT + " " + " ".join(random.Random(2).choices(MIT.split(), k=800)), "twice": MIT + " the and of " * 50 + MIT,
    "with a tenth replaced": " ".join(w if i % 10 else "other" for i, w in enumerate(MIT.split(), 5)),
}


def test_statements_anywhere(spark):
    docs = spark.createDataFrame(list(enumerate(CASES.values())), "doc_id int, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs).collect()}
    assert {name: got[i] for i, name in enumerate(CASES)} == dict.fromkeys(CASES, "mit")


def test_words_spread_over_a_page_are_no_license(spark):
    filler = " x" * 60
    docs = spark.createDataFrame([(1, f"released{filler} under{filler} the{filler} MIT{filler} license"), (2, " ".join(random.Random(3).sample(MIT.split(), len(MIT.split()))))], "doc_id int, text string")
    assert [r["license"] for r in license_scan.scan_licenses(docs).collect()] == [None, None]


def by_brute_force(scanner, words, t):
    """Whether any shortest run of the words, in any of the widths, aligns with template t; every run is counted anew."""
    template = scanner.words[t]
    need, goal = Counter(template), math.ceil(MIN_COVERAGE * len(template))
    at = [i for i, w in enumerate(words) if w in need]
    for hi in range(len(at)):
        have, total, lo = Counter(), 0, hi + 1
        while lo > 0 and total < goal:
            lo -= 1
            w = words[at[lo]]
            have[w] += 1
            total += have[w] <= need[w]
        if total < goal:
            continue
        for share in WIDER:
            more = math.ceil(share * len(template))
            a = max(i for i in range(lo + 1) if i == 0 or lo - i == more or (at[i - 1] < at[lo] - more / MIN_DENSITY))
            b = min(i for i in range(hi, len(at)) if i == len(at) - 1 or i - hi == more or at[i + 1] > at[hi] + more / MIN_DENSITY)
            pairs = [(at[a + i], j) for i, j in patience_align([words[k] for k in at[a : b + 1]], template)]
            if len(pairs) >= MIN_COVERAGE * len(template) and len(pairs) >= MIN_DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                if fits(words, pairs, template, license_scan.KEYS.get(scanner.names[t], [])):
                    return True
    return False


def fits(words, pairs, template, keys):
    """Whether no key speaks against the template, by the words themselves."""
    text_of, used = {j: i for i, j in pairs}, {i for i, _ in pairs}
    keys = [[w for w in map(core, k.encode().split()) if w] for k in keys]
    spots = [[range(i, i + len(k)) for i in range(len(template) - len(k) + 1) if template[i : i + len(k)] == k] for k in keys]
    spots = [s for s in spots if s]
    if len(template) <= license_scan.SHORT and not spots:
        spots = [[range(len(template))]]

    def state(spot):
        there = sorted(text_of[j] for j in spot if j in text_of)
        if len(there) * 2 < len(spot) or there[-1] - there[0] >= len(spot) / MIN_DENSITY:
            return 0
        low, high = there[0], there[-1]
        reach = 2 * len(spot) + 4
        if spot[0] not in text_of:
            left = [text_of[j] for j in (spot[0] - 3, spot[0] - 2, spot[0] - 1) if j in text_of]
            low = left[-1] if left and low - left[-1] <= reach else low
        if spot[-1] not in text_of:
            right = [text_of[j] for j in (spot[-1] + 1, spot[-1] + 2, spot[-1] + 3) if j in text_of]
            high = right[0] if right and right[0] - high <= reach else high
        if any(license_scan.telling(words[i]) for i in range(low + 1, high) if i not in used):
            return 0
        return 1 + (len(there) == len(spot))

    best = [max(map(state, s)) for s in spots]
    return all(b == 2 or (b == 1 and len(template) > license_scan.SHORT) for b in best)


FULL = {
    "mit": ("mit-text", "mit"), "isc": ("isc-text",), "bsd-3": ("bsd-3-clause-text", "bsd-3-clause"), "apache": ("apache-2.0-text",), "gpl-3": ("gpl-3-text",),
}


@pytest.mark.parametrize("name", FULL)
def test_noisy_whole_licenses_keep_their_name(name):
    """Every 6th, 7th, 8th, 10th or 15th word replaced, from each start: what still aligns is reported as what it is."""
    scanner, words = Scanner(TEMPLATES, MIN_COVERAGE), TEMPLATES[FULL[name][0]].split()
    wanted = [w for w in map(core, TEMPLATES[FULL[name][0]].encode().split()) if w]
    variants = [(k, i) for k in (6, 7, 8, 10, 15) for i in range(k)]
    lost = []
    for k, i in variants if len(words) < 1000 else variants[::5]:
        text = " ".join("qzx" if n % k == i else w for n, w in enumerate(words))
        found = [f for c in license_scan.chunks(license_scan.pa.array([text])) for f in scanner.scan(c)[0]]
        aligned = len(patience_align([w for w in map(core, text.encode().split()) if w], wanted)) / len(wanted)
        if aligned >= MIN_COVERAGE and (not found or found[0][0] not in FULL[name]):
            lost.append((k, i, found[:1]))
    assert not lost


def named(text):
    scanner = named.scanner
    found = [f for c in license_scan.chunks(license_scan.pa.array([text])) for f in scanner.scan(c)[0]]
    return found[0][0] if found else None


named.scanner = Scanner(TEMPLATES, MIN_COVERAGE)


def test_one_changed_word_and_near_misses():
    text = lambda n: TEMPLATES[n]
    assert named(text("mit-text").replace("this permission notice", "this permissions notice")) == "mit-text"
    assert named(text("isc-text").replace("this permission notice", "this permissions notice")) == "isc-text"
    assert named(text("bsd-3-clause-text").replace("endorse", "qzx")) == "bsd-3-clause-text"
    assert named(text("bsd-2-clause-text")) == "bsd-2-clause-text"
    assert named(text("gpl-3.0-or-later")) == "gpl-3.0-or-later" and named(text("gpl-3.0-only")) == "gpl-3.0-only"
    assert named(text("gpl-3.0-or-later").replace("version 3", "version 2")) == "gpl-2.0-or-later"
    assert named(text("gpl-3.0-or-later").replace("GNU General", "GNU Lesser General")) == "lgpl-3.0-or-later"
    assert named(text("gpl-3-text").replace("GNU General Public", "GNU Affero General Public")) != "gpl-3-text"
    assert named("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0-line" and named("Licensed under the Apache License, Version 9.") is None
    assert named(" ".join(text("mit").split()[: len(text("mit").split()) * 7 // 10])) is None


@pytest.mark.parametrize(("text", "name"), [("This is licensed under GPLv3 and more", "gpl-3.0"), ("Released under the GNU GPL v2", "gpl-2.0"), ("released under the Boost Software License", "boost-1.0"), ("Licensed under the Unlicense.", "unlicense"), ("licensed under GPLv9", None)])
def test_short_statements(text, name):
    found = named(text)
    assert found is None if name is None else found.startswith(name)


@pytest.fixture(scope="module")
def scanner():
    return Scanner({n: t for n, t in TEMPLATES.items() if len(t.split()) < 120}, MIN_COVERAGE)


def test_scan_agrees_with_brute_force(docs, scanner):
    rng, texts = random.Random(5), [r["text"] for r in docs.collect() if r["text"]]
    for name in rng.sample(scanner.names, 24):
        words = TEMPLATES[name].split()
        changed = [w if rng.random() > 0.15 else rng.choice(["the", "license", "version", "x"]) for w in words for _ in range(1 + (rng.random() < 0.1))]
        texts.append(" ".join(rng.choices(words, k=20) + changed + rng.choices(words, k=20)))
    for text in texts:
        words = [core(w) for w in text.encode().split()]
        found = {f[0] for c in license_scan.chunks(license_scan.pa.array([text])) for f in scanner.scan(c)[0]}
        have = Counter(words)
        possible = [t for t, own in enumerate(scanner.words) if sum((Counter(own) & have).values()) >= MIN_COVERAGE * len(own)]
        assert found == {scanner.names[t] for t in possible if by_brute_force(scanner, words, t)}, text[:200]

"""Benchmark decontamination against a plain scan of every window position."""

import hashlib
import random
import re

import pytest

from storelens.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            n = len(window)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == window:
                    hit.update(range(p, p + n))
                    found |= {i for i in owners if i is not None}
        listed = ",".join(sorted(str(i) for i in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.summarised(decontamination.find_contamination(d, b)).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("probe_bytes", [decontamination.PROBE_BYTES, 0])
def test_against_plain_scan(spark, monkeypatch, probe_bytes):
    """Both ways: verification in the scan (probes broadcast) and candidates shuffled to their texts."""
    monkeypatch.setattr(decontamination, "PROBE_BYTES", probe_bytes)
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "épée", "x1", "the", "of", "42"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", ".", "!!"])

    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(None, "beta beta"), (7, text(12))]
    docs = [(i, text(rng.randint(0, 80))) for i in range(120)]
    docs += [(500, items[6][1]), (500, items[6][1]), (None, None), (501, "")]
    assert run(spark, docs, items) == plain(docs, items)


def test_case_punctuation_and_bounds(spark):
    item = "One two three four five six seven eight nine ten eleven"
    docs = [
        (1, "ONE two, three-four five; six seven eight nine ten"),  # first window, other separators
        (2, "two three four five six seven eight nine ten eleven end"),  # second window only
        (3, "one two three four five six seven eight nine"),  # nine words: too short for a window
        (4, "x " + item.lower() + " y"),
    ]
    got = {r[0]: r[1:] for r in run(spark, docs, [(9, item), (10, "nothing here at all")])}
    assert got[1][:3] == (10, 10, 1) and got[2][:3] == (11, 10, 1) and got[3][:3] == (9, 0, 0) and got[4][:3] == (13, 11, 1)
    assert got[3][4] is False and got[3][3] == hashlib.sha256(b"").hexdigest()


def test_odd_rows_and_clashing_columns(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "")], "item_id bigint, text string")
    clashing = items.selectExpr("*", "'x' as window", "'y' as key", "1 as n")
    got = decontamination.summarised(decontamination.find_contamination(odd, clashing)).collect()
    assert len(got) == odd.count()
    hits = sorted((r.doc_id, r.n_hit) for r in got if r.contaminated)
    assert hits == [(4, 6), (4, 6), (5, 6)]
    assert decontamination.find_contamination(nothing, items).count() == 0
    assert decontamination.find_contamination(odd, items.where("false")).where("contaminated").count() == 0

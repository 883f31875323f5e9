import re

import pytest

from tapeloom.llm import host_rules as H


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    (20, "a b c a b c a b c"), (21, "x x x x x x"), (22, "a b c d a b c e\n\na b c d a b c e\n \n"), (23, "é ü z\x0bq"), (24, "## || $$ %% && <> ** " * 30), (25, "a b c"), (26, "one\r\ntwo\r\none\r\n"),
    (27, " ".join(f"u{i}" for i in range(80))), (28, "p q " * 40),
]


def test_counts_against_brute_force(make, edge_texts):
    texts = edge_texts + TEXTS
    rows = H.document_rules(make(texts)).collect()
    got = sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows)
    assert got == sorted((d, brute(t)) for d, t in texts)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


def test_hosts_are_drawn_to_the_mean(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [("big", good)] * 60 + [("big", bad)] * 40 + [("awful", bad)] * 50 + [("fine", good)] * 50 + [("one", bad)] + [(None, bad)] * 20
    docs = spark.createDataFrame([(i, t, h, 1, True) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, n_words int, kept boolean")
    hosts = {r.host: r for r in H.host_verdicts(H.document_rules(docs)).collect()}
    rates = [40 / 100, 1, 0, 1, 1]
    mean = sum(rates) / 5
    var = sum((x - mean) ** 2 for x in rates) / 5
    size = mean * (1 - mean) / var - 1
    assert hosts["one"].drawn_rate == pytest.approx((1 + mean * size) / (1 + size))
    assert {h: r.host_kept for h, r in hosts.items()} == {"big": True, "awful": False, "fine": True, "one": False, None: False}
    kept = H.quality_rules(docs).filter("kept").collect()
    assert len(kept) == 110 and {r.host for r in kept} == {"big", "fine"}


def test_one_host_and_empty(make, edge_texts):
    docs = make([(1, "short"), (2, " ".join(f"w{i}" for i in range(60)))])
    assert H.host_verdicts(H.document_rules(docs, "lang"), 0.6).count() == 1
    assert H.quality_rules(make([])).count() == 0
    assert H.quality_rules(make(edge_texts)).count() == len(edge_texts)
    plan = H.document_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

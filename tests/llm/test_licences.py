"""Licence scan against a scorer in plain Python that looks at every line and window, without any filter."""

import random
import re
import textwrap

import numpy as np
import pyarrow.parquet as pq
import pytest
from plumbline.llm import license_scan
from tests.llm.test_corpus import WRAPPED

SF = "/root/testdata/sf0.001"
TRIGGER = re.compile(license_scan.TRIGGERS)


def judged(words):
    """(family, coverage, best coverage of any family) of a sequence of words."""
    m = license_scan.model()
    found = license_scan.grams(" ".join(words))
    index = judged.index = getattr(judged, "index", None) or {g: i for i, g in enumerate(m["vocabulary"])}
    logits = m["bias"] + m["weights"][[index[g] for g in found if g in index]].sum(axis=0)
    family = m["families"][int(np.argmax(logits))]
    covers = [(f, sum(g in found for g in t) / len(t)) for f, t in m["templates"]]
    return family, max([c for f, c in covers if f == family], default=0.0), max(c for _, c in covers)


def brute_scan(text):
    """licences, n_notices, n_unknown of one document."""
    text = (text or "").lower()
    by_line, notices, unknown, by_window = set(), 0, 0, set()
    for line in text.split("\n"):
        family, cover, _ = judged(re.findall(license_scan.WORD, line))
        if cover >= license_scan.COVERAGE - 1e-9:
            by_line.add(family)
            notices += 1
        else:
            unknown += bool(TRIGGER.search(line))
    stripped = re.sub(r"(?m)^[^a-z0-9\n]*(?:rem|dnl)[ \t]", "", text)
    for block in re.split(license_scan.GAP, stripped):
        words = re.findall(license_scan.WORD, block)
        for size, step in license_scan.WINDOWS:
            for i in range(0, max(0, len(words) - size + step - 1) + 1, step):
                family, cover, best = judged(words[i:i + size])
                if cover >= license_scan.COVERAGE - 1e-9 and cover >= best - 1e-9:
                    by_window.add(family)
    return ",".join(sorted(by_line | by_window)), notices + len(by_window - by_line), unknown


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


def cases():
    rng = random.Random(0)
    out = [None, "", "\n\n"]
    for text in WRAPPED.values():
        flat = " ".join(text.split())
        for width in (30, 50, 72):
            out.append("\n".join(textwrap.wrap(flat, width)))
        for mark in ("# ", " * ", "// ", "rem ", "dnl ", ";; REM\t"):
            out.append(commented("\n".join(textwrap.wrap(flat, 60)), mark))
        words = flat.split()
        for share in (2, 3, 4):  # truncated at either end, or with words left out
            out += [" ".join(words[:len(words) // share]), " ".join(words[-(len(words) // share):]), " ".join(w for w in words if rng.random() > 1 / (4 * share))]
    for family, texts in license_scan.TEMPLATES.items():
        out += [t.upper() + " " + " ".join(rng.choices("of and the in that file".split(), k=5)) for t in texts]
    return out + list(license_scan.OTHER)


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: (r["licences"], r["n_notices"], r["n_unknown"]) for r in license_scan.scan(docs).collect()}


def test_wrapped_commented_and_truncated_texts(spark):
    texts = cases()
    got = scanned(spark, texts)
    wrong = {i: (got[i], brute_scan(t)) for i, t in enumerate(texts) if got[i] != brute_scan(t)}
    assert not wrong, list(wrong.items())[:3]


def test_documents(spark):
    """Every document and whole text of the smallest table."""
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    want = sorted((d, *brute_scan(t)) for d, t in zip(docs["doc_id"], docs["text"]))
    got = sorted((r["doc_id"], r["licences"], r["n_notices"], r["n_unknown"]) for r in license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == want
    assert sum(bool(w[1]) for w in want) >= 3


def test_recall_and_precision(spark):
    """Standard texts, wrapped and commented, are found as their family; sentences about licences are not."""
    texts, families = [], []
    for family, text in WRAPPED.items():
        flat = " ".join(text.split())
        for width, mark in ((40, "# "), (60, " * "), (76, ""), (70, "rem ")):
            texts.append(commented("\n".join(textwrap.wrap(flat, width)), mark))
            families.append(family.split(" ")[0])
    got = scanned(spark, texts + list(license_scan.OTHER))
    hits = [f in got[i][0].split(",") for i, f in enumerate(families)]
    false = [i for i in range(len(texts), len(got)) if got[i][0]]
    assert sum(hits) == len(hits) and not false


def test_key_grams_lose_nothing():
    """What has no key n-gram cannot cover enough of any template."""
    keys = license_scan.key_grams()
    holds = lambda g: any(f" {k} " in f" {g} " for k in keys)
    for _, template in license_scan.model()["templates"]:
        assert sum(not holds(g) for g in template) < license_scan.COVERAGE * len(template) - 1e-9


@pytest.mark.parametrize("text,found", [
    ("the mit license", True), ("the mit\n# license", True), ("the mit\nrem license", True), ("an mit licenses", False), ("bathe mitre license", False),
    ("the xmit license", False), ("", False)])
def test_key_pattern(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").where(f"t rlike '{license_scan.key_pattern().replace(chr(92), chr(92) * 2)}'").count() == found

"""Mixing, quality, licences, the pipeline and the guard of the entry point."""

import os
import shutil
import subprocess
import sys
import zlib

import numpy as np
import pytest
from plumbline.llm import license_scan, mixing, quality, queries, shared

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def size(text):
    return len((text or "").encode().split())


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= over
    return target


MIX = [(i, "w " * (i % 17), s) for i, s in enumerate(["b", "a", None, "é", "z", "a"] * 50)] + [(None, None, "a"), (7, "one", "empty"), (7, "one", "empty"), (8, None, "void")]


@pytest.mark.parametrize("rows_per_range", [2000, 5])
def test_mix(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows_per_range)
    docs = spark.createDataFrame([(*r, 1, 2) for r in MIX], "doc_id long, text string, source string, size int, key int")
    plan = mixing.mix_plan(docs).collect()
    sizes = {}
    for _, t, s in MIX:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = expected_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in plan) == sorted((d is None, d or 0, size(t)) for d, t, _ in MIX)
    by_target = {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r["size"]
        by_target.setdefault((r.source_size, round(r.target, 3)), 0)
        by_target[r.source_size, round(r.target, 3)] += r.taken
    assert set(by_target) == {(sizes[s], round(t, 3)) for s, t in target.items()}
    for (n, t), taken in by_target.items():
        assert abs(taken - t * sum(1 for s in target if (sizes[s], round(target[s], 3)) == (n, t))) <= 3
    again = sorted(map(str, mixing.mix_plan(docs).collect()))
    assert again == sorted(map(str, plan))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_quality_learns_from_other_folds(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None, "s"), (None, "", "s"), (2, "x" * 100_000, "s"), (2, "a b", "t"), (2, "a b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.quality_scores(docs, labels)
    assert got.count() == 5 and got.where("score between 0 and 1").count() == 5
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_additive_model_separates():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.AdditiveModel(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_mix_of_rows_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"w {i} " * (i % 5), f"s{i % 3}", i, i, i) for i in range(40)], ["doc_id", "text", "source", "a.b", "row`x", "key"])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    words = {}
    for r in mixed.collect():
        assert r["a.b"] == r["row`x"] == r["key"] == r["doc_id"]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(words.get(d, 0) == n for d, n in plan.items())


def test_licence_notices(spark):
    lines = [(text, family) for family, texts in license_scan.TEMPLATES.items() for text in texts]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan(docs).collect()}
    notices = [i for i, (t, _) in enumerate(lines) if "icen" in t or "reserved" in t or "SPDX" in t or "Redistribution" in t or "Permission" in t]
    assert len(notices) == len(lines)
    assert [got[i] for i in notices] == [lines[i][1] for i in notices]


def test_licence_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "see the MIT License (MIT) for details\nLicensed under CC BY-NC 4.0."), (3, "A license is required to drive a car\nLicense plates are metal"),
            (4, "The MIT License (MIT)"), (4, "The MIT License (MIT)"), (5, "mit licensed beer was sold at the fair\n" * 500)]
    got = sorted(map(str, (tuple(r) for r in license_scan.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")).collect())))
    assert got == sorted(map(str, [(1, "", 0, 0), (2, "", 0, 0), (None, "CC-BY-NC,MIT", 2, 0), (3, "", 0, 2), (4, "MIT", 1, 0), (4, "MIT", 1, 0), (5, "", 0, 500)]))
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from plumbline.llm import packing
    from tests.llm.test_dedup import near_expected
    from tests.llm.test_packing import check_sequences, expected_pieces

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF))
        results.append(docs)
    good, exact, near, mixed, packed = results
    before = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p}
    norm = lambda r: "".join(r.text.split())
    assert sorted(map(norm, exact.collect())) == sorted(set(map(norm, good.collect())))
    want = near_expected([(r.doc_id, r.text) for r in exact.collect()])
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in want}
    plan = {r.doc_id: r for r in mixing.mix_plan(near).collect()}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert words == {d: r.taken for d, r in plan.items() if r.taken}
    table = packed.toPandas()
    assert sorted(table[list(packing.OUT[:5])].itertuples(index=False, name=None), key=str) == expected_pieces(
        [(r.doc_id, r.text) for r in mixed.collect()], queries.tokenizer_path())
    check_sequences(table)
    assert all(x.columns == before.columns for x in results[:-1])


@pytest.mark.parametrize("without", [("plumbline/llm", "corpus_pipeline.py"), ("plumbline/llm",), ("corpus_pipeline.py",), ()])
def test_entry_point_without_this_package(tmp_path, without):
    for name in ("plumbline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=lambda d, names: [n for n in names if n == "__pycache__" or os.path.relpath(os.path.join(d, n), ROOT) in without])
        elif name not in without:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["0" if without else "13"]


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD": """BSD 3-Clause License

Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "ISC": """ISC License

Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
}


def test_licence_wrapped_texts(spark):
    marks = ("", " * ", "# ", "// ", "dnl ")
    rows = [(f"{family} {m}", "\n".join(m + line for line in text.split("\n"))) for family, text in WRAPPED.items() for m in marks]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan(docs).collect()}
    assert {name: got[i] for i, (name, _) in enumerate(rows)} == {name: name.split()[0] for name, _ in rows}


def test_licence_lines_without_trigger(spark):
    rows = [(1, "This is free and unencumbered software released into the public domain."), (2, "This Source Code Form is subject to the terms of the Mozilla Public")]
    got = {r.doc_id: (r.licences, r.n_notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Unlicense", 1), 2: ("MPL", 1)}

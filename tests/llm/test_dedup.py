"""De-duplication and joins against brute force, with edge cases."""

import contextlib
import gc
import hashlib
import itertools
import pathlib
import re
import threading
import uuid

import numpy as np
import pytest
from plumbline.llm import components, embedding_dedup, exact_dedup, ngram_join, queries, substring_dedup
from pyspark.sql import types as T
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(400))
EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d"), (7, LONG), (8, LONG), (8, LONG), (9, LONG + " tail"), (None, LONG),
    (10, "x " * 3000), (11, "x " * 2990), (12, "nb sp one two"), (13, LONG.replace("w3 ", "v3 ")), (14, LONG.upper()), (14, "other text of document fourteen"),
    (15, "é" * 2000 + "."), (16, "é" * 2000 + " ."), (-3, "one"), (17, "a\x00b c d e f"), (None, None),
]


def edge(spark, rows=EDGE):
    """Rows with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "en", 1, "k", 2) for r in rows], "doc_id long, text string, lang string, n int, key string, row_id int")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def components_of(n, links):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, name):
    problem = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name])
    assert problem is None, problem


def exact_expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), d is None, d or 0, d, t))
    best = {k: min(v, key=lambda r: r[:3]) for k, v in groups.items()}
    out = []
    for d, t in rows:
        norm = BLANK.sub("", t or "")
        keep = best[norm]
        out.append((d, keep[3], len(groups[norm]), (d, t or "") == (keep[3], keep[4] or ""), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_edge_cases(spark, bits):
    got = sorted((tuple(r)[:5] for r in exact_dedup.exact_groups(edge(spark), bits).collect()), key=str)
    assert got == exact_expected(EDGE)


def test_exact_dedup_keeps_one(spark):
    kept = exact_dedup.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    norms = [BLANK.sub("", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({BLANK.sub("", t or "") for _, t in EDGE})
    assert exact_dedup.keep_one(edge(spark).limit(0)).count() == 0


def test_contested_digests_are_found(spark):
    assert exact_dedup.contested_digests(edge(spark), 3).count() > 0
    assert exact_dedup.contested_digests(edge(spark)).count() == 0


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components_of(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], len(sets[i]), least[root[i]] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def variants(seed, n, base_words=80):
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(base_words)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(base_words, int(rng.integers(0, 5)), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [EDGE, variants(1, 60), variants(2, 90, 24)], ids=["edge", "hot group", "short texts"])
def test_ngram_join(spark, rows):
    got = sorted((tuple(r) for r in ngram_join.similar_groups(edge(spark, rows)).collect()), key=str)
    assert got == near_expected(rows)


def test_ngram_join_without_stars(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rows = variants(3, 50)
    assert sorted((tuple(r) for r in ngram_join.similar_groups(edge(spark, rows)).collect()), key=str) == near_expected(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_groups(edge(spark).limit(0)).count() == 0
    assert ngram_join.keep_first(edge(spark)).columns == edge(spark).columns


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 20, 100, 1001])
def test_needed_overlap_is_safe(n):
    need = int(ngram_join.needed_overlap(n))
    assert need * 100 >= 80 * n > (need - 1) * 100


def substring_expected(rows):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                g = tuple(w[i:i + 13])
                owner[g] = min(owner.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if d is not None and owner[tuple(w[i:i + 13])] < d for k in range(13)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = np.random.default_rng(seed)
    shared = [[f"p{k}_{i}" for i in range(length)] for k, length in enumerate((12, 13, 14, 25, 60))]
    rows = []
    for d in range(60):
        w = []
        for _ in range(4):
            w += [f"u{d}_{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(0, 15)))]
            w += shared[int(rng.integers(0, 5))]
        rows.append((d, "  \n".join(w)))
    return rows


@pytest.mark.parametrize("rows", [EDGE, passages(1), passages(2)], ids=["edge", "passages", "more passages"])
def test_substring_dedup(spark, rows):
    got = sorted((tuple(r) for r in substring_dedup.without_repeats(edge(spark, rows)).collect()), key=str)
    assert got == substring_expected(rows)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.without_repeats(edge(spark).limit(0)).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def vectors(seed, n=300, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.uniform(0.05, 0.6, (n, 1)) * rng.standard_normal((n, dims))
    x[rng.integers(0, n, 20)] = x[0]
    return x.astype(np.float32)


def embedding_expected(rows):
    valid = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for i, j in itertools.combinations(valid, 2):
        if len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                links.append((i, j))
    root = components_of(len(rows), links)
    degree = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], int(degree[i]), least[root[i]], rows[i][0] is None or rows[i][0] == least[root[i]]) for i in range(len(rows))), key=str)


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [1.0, 0.0]),
       (9, [1.0, 0.48]), (10, [1.0, 0.49]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (None, [0.0, 3.0])]


@pytest.mark.parametrize("tile", [8192, 16])
@pytest.mark.parametrize("rows", [ODD, [(i, [float(x) for x in v]) for i, v in enumerate(vectors(1))], [(i, [float(x) for x in v]) for i, v in enumerate(vectors(2, 120, 7))]],
                         ids=["odd", "clusters", "few axes"])
def test_embedding_join(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, size string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert got == embedding_expected(rows)


TWINS = [(1, [1.0]), (2, [1.0, None]), (3, [0.0, -1.0]), (4, [-0.0, -2.0]), (5, [-0.0, -1.0]), (None, [1.0]), (None, [1.0, float("nan")]), (6, [-1.0]), (7, [1e-30, 0.0])]


@pytest.mark.parametrize("element", ["float", "double"])
def test_embeddings_that_hash_alike(spark, element):
    """Spark's hash passes over nulls, and takes the zeros for one."""
    frame = spark.createDataFrame(TWINS, f"vec_id long, embedding array<{element}>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert got == embedding_expected(TWINS)


def test_tiles_against_brute_force():
    rng = np.random.default_rng(5)
    unit = embedding_dedup.unit_vectors(np.concatenate([rng.standard_normal((700, 64)), vectors(3, 900), np.ones((40, 64)) + rng.uniform(0, 0.2, (40, 64))]))
    unit = unit[rng.permutation(len(unit))]
    size, axes = rng.integers(1, 4, len(unit)), np.linalg.qr(rng.standard_normal((64, 64)))[0]
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    for near, begin in itertools.product((8, 24, 64), (0, 600)):  # one tile with itself, or two tiles
        cuts = [slice(0, begin), slice(begin, None)][begin == 0:]
        tiles = [embedding_dedup.Tile(n, unit[s], (unit[s] @ axes[:, :near]).astype(np.float32), size[s]) for n, s in enumerate(cuts)]
        links, root = embedding_dedup.tile_links(tiles[0], tiles[-1])
        expected = linked.copy()
        if begin:
            expected[:begin, :begin] = expected[begin:, begin:] = False
        assert links.tolist() == (expected @ size).tolist()
        parts = components_of(len(unit), list(zip(*np.nonzero(expected))))
        assert len(set(zip(parts, root.tolist()))) == len(set(parts)) == len(set(root.tolist()))


def test_embeddings_on_disk_grow_with_vectors_not_with_their_pairs(spark, monkeypatch, tmp_path):
    """Vectors without structure in many tiles: what is shuffled and written is a few times the input."""
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    monkeypatch.setattr(embedding_dedup.shared, "shared_folder", lambda spark: f"{tmp_path}/{uuid.uuid4().hex}")
    disk = [d.toString() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def used():
        found = 0
        for f in (f for d in [*disk, tmp_path] for f in pathlib.Path(d).rglob("*") if f.suffix in (".data", ".parquet")):
            with contextlib.suppress(OSError):  # Spark removes files meanwhile
                found += f.stat().st_size
        return found

    n, dims = 1500, 64
    rows = np.random.default_rng(9).standard_normal((n, dims)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    gc.collect()
    spark._jvm.System.gc()
    before, seen, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            seen.append(used())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert embedding_dedup.near_duplicates(frame).where("n_links = 0 AND kept AND component_id = vec_id").count() == n
    finally:
        over.set()
        watcher.join()
    assert max(seen) - before < 5 * rows.nbytes


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (20, 10), (4, 4)] + [(100 + i, 101 + i) for i in range(60)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(2, 1), (3, 1), (6, 5), (7, 5), (8, 5), (9, 5), (20, 10)} | {(101 + i, 100) for i in range(60)}


CLASHES = ["id", "tag", "own", "kept", "__id", "__gone", "first", "a.b", "row`x"]


def clashing(spark, rows):
    """Rows with columns named like those that the operators use, a dot and a back quote among them."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in CLASHES]])
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], schema)


NEAR = " ".join(f"n{i}" for i in range(120))
SHARED_IDS = [(1, NEAR), (2, NEAR + " x"), (2, "a different text of document two with words of its own"), (None, NEAR + " y"), (None, NEAR + " y z"),
              (None, "a text without a number that nothing else is like"), (3, NEAR.upper()), (3, NEAR.upper()), (4, None), (4, ""), (5, " "), (0, "a b c d e f g h")]


def test_near_copies_that_share_ids_or_have_none(spark):
    """Only the near copies go: not the other text of the same doc_id, and not one of the null ids with a text of its own."""
    docs = clashing(spark, SHARED_IDS)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    gone = {(2, NEAR + " x"), (None, NEAR + " y"), (None, NEAR + " y z"), (3, NEAR.upper())}
    assert got == sorted([r for r in SHARED_IDS if r not in gone and r != (4, None)], key=str) or got == sorted(
        [r for r in SHARED_IDS if r not in gone and r != (4, "")], key=str)  # null and empty are one document


def test_near_copies_without_any_number(spark):
    kept = ngram_join.keep_first(clashing(spark, [(None, NEAR), (None, NEAR + " x"), (None, NEAR), (None, "something else altogether in this row")])).collect()
    assert len(kept) == 2 and len({r["text"] for r in kept}) == 2


@pytest.mark.parametrize("seed", range(3))
def test_one_row_of_each_component_stays(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 12)) if rng.random() > 0.2 else None, t) for _, t in variants(seed, 40, 30)] + [(3, "the odd one " * 4), (None, None)]
    rows = list({(d, t): None for d, t in rows})
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components_of(len(rows), links)
    got = [(r["doc_id"], r["text"]) for r in ngram_join.keep_first(clashing(spark, rows)).collect()]
    assert len(got) == len(set(root)) and sorted(root[rows.index(g)] for g in got) == sorted(set(root))
    for r in set(root):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == r]
        mine = next(g for g in got if root[rows.index(g)] == r)
        assert mine[0] == min((i for i in ids if i is not None), default=None)


def test_exact_dedup_with_clashing_columns(spark):
    docs = clashing(spark, SHARED_IDS)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    norms = [BLANK.sub("", r["text"] or "") for r in kept.collect()]
    assert sorted(norms) == sorted({BLANK.sub("", t or "") for _, t in SHARED_IDS})

"""Whitening, filter interactions and the rule ensemble against brute force, on small tables with awkward rows."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfront.llm import common, interactions, oracles, queries, rules, token_output, whitening

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


# ---- operator 11 ----------------------------------------------------------------------------------------------------

def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, whitened int, `a.b` string").repartition(3)


def exact_whitening(rows, k=8):
    """x, components by extended precision, from Python whole numbers."""
    x = np.array([[math.floor(float(np.float32(c)) * 1024) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    apart = x * n - s
    centred = (apart / n).astype(np.float64)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return [int(a) for a in (apart * apart).sum(axis=1)], centred, values[order], vecs[:, order][:, :k]


def test_whitening_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    mixed = (rng.normal(size=(300, 12)) * np.logspace(0, -2, 12)) @ rng.normal(size=(12, 12))
    good = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    good += [good[0], good[0], (None, good[1][1])]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [1.0] * 11),
           (904, []), (905, [1.0] * 5)]
    got = whitening.whitened_components(vectors(spark, good + bad)).toPandas()
    deviations, centred, values, vecs = exact_whitening(good)
    assert len(got) == 8 * len(good) and set(got.n) == {len(good)}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    z = centred @ vecs / np.sqrt(values[:8])
    for j in range(8):
        mine = got[got.component == j + 1]
        assert sorted(int(d) for d in mine.deviation) == sorted(deviations)
        assert np.allclose(mine.explained, values[j] / values.sum(), rtol=1e-8)
        sign = 1 if np.abs(mine.whitened.sort_values().to_numpy() - np.sort(z[:, j])).max() < 1e-6 else -1
        assert np.allclose(np.sort(mine.whitened.to_numpy()), np.sort(sign * z[:, j]), atol=1e-7)
    first = got[(got.vec_id == 0) & (got.component == 1)]
    assert len(first) == 3 and first.whitened.nunique() == 1


def test_whitening_of_dependent_columns(spark):
    """Constant and repeated dimensions: the variance that is there is whitened, the rest is 0."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(200, 3))
    rows = [(i, [float(v[0]), float(v[0]), 5.0, float(v[1]), float(v[2]), 0.0]) for i, v in enumerate(a)]
    got = whitening.whitened_components(vectors(spark, rows)).toPandas()
    _, centred, values, _ = exact_whitening(rows)
    assert sorted(set(got.component)) == [1, 2, 3, 4, 5, 6]
    live = got[got.component <= 3]
    for j in range(3):
        assert np.allclose(live[live.component == j + 1].explained, values[j] / values.sum(), rtol=1e-8)
        assert abs((live[live.component == j + 1].whitened ** 2).mean() - 1) < 1e-8
    assert (got[got.component > 3].explained == 0).all() and (got[got.component > 3].whitened == 0).all()
    assert got.identity_error[0] < 1e-8


def test_whitening_small_and_large_numbers(spark):
    assert whitening.whitened_components(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whitened_components(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in sorted(one, key=lambda r: r.component)] \
        == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    rows = [(i, [2e12 * i, float(i * i), -1e11 * (i % 3)]) for i in range(40)]
    got = whitening.whitened_components(vectors(spark, rows, "double")).filter("component = 1").collect()
    x = [[math.floor(c * 1024) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want and max(want.values()) > 2 ** 63
    with pytest.raises(Exception, match="fixed-point"):
        whitening.whitened_components(vectors(spark, [(1, [1e30]), (2, [1.0])]))


def test_shifted_passes_on_ill_conditioned_rows():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(500, 6)) @ np.diag([1, 1e-2, 1e-5, 1e-7, 1e-8, 1e-9])
    r, trace = whitening.triangular_factor(
        lambda fs: (lambda q: q.T @ q)(whitening.orthogonalised(a, fs)), 500, 6)
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(a, compute_uv=False), rtol=1e-6)
    assert math.isclose(trace, float((a * a).sum()), rel_tol=1e-12)


# ---- operator 12 ----------------------------------------------------------------------------------------------------

def audit_documents():
    prose = " ".join(RNG.choice(WORDS) for _ in range(260))
    texts = [None, "", "", "short", prose, prose, prose, "LOUD " * 300, prose + " 5% off", prose.upper(), "a b\x0bc d " * 90,
             "x" * 50_000, "$", prose + "!"]
    rows = [(i * 3 % 17, t, ("a", "b", None, "")[i % 4], "z") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, prose, "a", "z"), (None, "", None, "z"), (99, prose, "b", "z")]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, None, 1), (9, 1, None), (12, 1, 1), (15, 0, 1), (None, 1, 1), (99, 1, 0), (500, 1, 1)]


def replayed(documents, labels):
    """Every order run over every document, one at a time."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in documents:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, s, *_ in documents:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failed.append((s or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in failed}:
        mine = [d for d in failed if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine),
                                          sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(spark, documents, labels):
    docs = spark.createDataFrame(documents, "doc_id long, text string, source string, mask string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select(
        "doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return interactions.audit_filters(docs, marks, interactions.quality_filters())


def test_filter_audit_against_replay(spark):
    got = audit(spark, audit_documents(), LABELS)
    assert got.count() == 120 * 5 * 3
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == replayed(audit_documents(), LABELS)
    assert audit(spark, [], LABELS).count() == 0
    unlabelled = audit(spark, audit_documents(), [])
    assert {tuple(r[c] for c in AUDIT) for r in unlabelled.collect()} == replayed(audit_documents(), [])


def test_filter_audit_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracles.FILTER_AUDIT)
    got = queries.op12_filter_audit(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_potential_gives_shapley_of_other_games(spark):
    """Three filters without the copy test, against the average over orders."""
    names = ["p", "q", "r"]
    filters = {"p": lambda t, w: F.size(w) > 2, "q": lambda t, w: t.contains("x"), "r": lambda t, w: t.contains("y")}
    texts = ["x", "y", "x y", "a b c x", "a b c", "q", "y y y", "x y z w"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, good boolean")
    rows = interactions.audit_filters(docs, marks, filters).collect()
    failed = [{n for n, bad in zip(names, (len(t.split()) > 2, "x" in t, "y" in t)) if bad} for t in texts]
    want = collections.Counter()
    for order in itertools.permutations(names):
        for f in failed:
            hit = [n for n in order if n in f]
            want.update(hit[:1])
    assert len(rows) == 18 and {(r.filter_order[r.step - 1], r.shapley) for r in rows} == set(want.items())


# ---- operator 13 ----------------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    unseen = [(r.predicted, q) for r, q in labels if r.held_out]
    assert sum(p == q for p, q in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_statistics_by_hand():
    s = dict(zip(rules.NAMES, rules.statistics("Ab 1!\nAb ü|. Ab")))
    assert s["upper"] == 3 / 15 and s["digit"] == 1 / 15 and s["space"] == 4 / 15 and s["symbol"] == 1 / 15
    assert s["words"] == 5 and s["distinct_words"] == 3 / 5 and s["word_length"] == 3
    assert s["distinct_lines"] == 1 and s["line_words"] == 2.5 and s["closed_words"] == 2 / 5
    assert rules.statistics(None) == rules.statistics("") and not any(map(math.isnan, rules.statistics("")))
    assert rules.statistics("x y")[rules.NAMES.index("words")] == 1  # no ASCII blank: one word


def test_rules_compile_to_columns(spark):
    """Scores from the compiled columns equal rules evaluated in Python; awkward rows have a score."""
    texts = [None, "", " ", "BUY NOW!! " * 50, "x" * 70_000, " ".join(WORDS), "日本 語", "a\x00b", "a | b |"] * 2
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0.5) for i, t in enumerate(texts)],
                                 "doc_id long, text string, s_words double").repartition(3)
    labels = spark.createDataFrame(
        [(i, int("BUY" not in (t or "") and "|" not in (t or ""))) for i, t in enumerate(texts)] + [(2, 0), (None, 1), (5, None), (6, 7)],
        "doc_id long, label int")
    measured = rules.measured(docs, "doc_id")
    model = rules.train(measured, labels, lasso=0.0001)
    assert model.weighted
    got = collections.Counter((r.doc_id, round(r.score, 9)) for r in rules.score(measured, model).collect())
    want = collections.Counter()
    for i, t in enumerate(texts):
        s = dict(zip(rules.NAMES, rules.statistics(t)))
        z = model.bias + sum(w for r, w in model.weighted if all(low < s[n] <= high for n, low, high in r.bounds))
        want[i if i != 3 else None, round(1 / (1 + math.exp(-z)), 9)] += 1
    assert got == want


def test_quality_without_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    one = rules.rate_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int")).collect()
    assert {r.score for r in one} == {0.75}
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in rules.rate_quality(docs, none).collect()} == {0.5}
    assert rules.rate_quality(docs.filter("doc_id < 0"), none).count() == 0


# ---- operator 1: hot ids, chunk table, file format --------------------------------------------------------------------

def test_chunk_table_lookup_forgets_and_finds_again():
    asked = []

    def segment(chunks):
        asked.extend(chunks)
        return [None if c == "odd" else c.encode() for c in chunks]
    table = common.ChunkTable(segment, limit=3, longest=5)
    assert table.values(["a", "b", "odd", "longer chunk"]) == [b"a", b"b", None, b"longer chunk"]
    assert table.values(["a", "longer chunk", "c"]) == [b"a", b"longer chunk", b"c"]
    assert table.values(["d", "e", "f", "g"])[3] == b"g" and table.values([]) == []
    assert table.values(["a", "odd"]) == [b"a", None]
    assert asked.count("longer chunk") == 2 and len(table.known) <= 4 and len(table.older) <= 5


def test_rows_that_share_an_id_are_spread_over_files(spark, tmp_path):
    rows = [(None if i % 4 else i, f"text number {i} " * 5) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = token_output.token_output(docs, queries.tokenizer_json(), 0, str(tmp_path / "t"))
    per_file = {r.part: r["count"] for r in token_output.read_tokens(spark, str(tmp_path / "t")).groupBy("part").count().collect()}
    assert max(per_file.values()) < 700 and sum(per_file.values()) == 2000
    out = sorted(got.collect(), key=lambda r: r.start)
    assert [r.start for r in out] == list(itertools.accumulate((r.n_tokens for r in out), initial=0))[:-1]
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(ids)


def test_token_files_have_the_stated_encodings_and_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    path = str(tmp_path / "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_output.write_tokens(docs, path, queries.tokenizer_json(), row_group_bytes=64 << 10, page_rows=4)
    groups = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            for c in ("doc_id", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[c].encodings and not columns[c].has_dictionary_page
                assert columns[c].has_offset_index and columns[c].has_column_index
            assert any("DICTIONARY" in e for c, x in columns.items() if c.startswith("ids") for e in x.encodings)
    assert groups >= 1
    plan = token_output.read_ids(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]

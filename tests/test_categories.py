"""C12 and C13 against one-by-one replays; connected components against a plain search."""

import random

import pytest

from conftest import rows
from shopfront.functions.components import component_roots
from shopfront.operators import changes as C

AS_OF = "2024-02-01"
CATS = "id long, name string, description string, parent_id long, created_at timestamp_ntz"


def _upsert_replay(cats, batch):
    names, out, inserted = {c[0]: c[1] for c in cats}, {}, []
    for seq, cid, name in sorted(batch):
        low = name.lower() if name is not None else None
        def holders(but=None):
            return [k for k, v in names.items() if v is not None and low is not None and v.lower() == low and k != but]
        if cid is None:
            out[seq] = C.NAME_TAKEN if holders() else None
            if out[seq] is None:
                names["new", seq] = name
                inserted.append(seq)
        elif name and holders(cid):
            out[seq] = C.NAME_TAKEN
        elif cid not in names:
            out[seq] = C.NO_CATEGORY
        else:
            out[seq] = None
            names[cid] = name if name is not None else names[cid]
    return out, names


def _upsert(spark, cats, batch):
    table = spark.createDataFrame([(i, n, None, None, None) for i, n in cats], CATS)
    frame = spark.createDataFrame([(s, i, n, None, None) for s, i, n in batch],
                                  "seq long, id long, name string, description string, parent_id long").repartition(3)
    ch = C.upsert_categories(table, frame, AS_OF)
    return {r["seq"]: r["error"] for r in rows(ch.outcome)}, {r["id"]: r["name"] for r in rows(ch.tables["categories"])}


def test_refused_rows_hold_no_name_and_renamed_ones_give_it_back(spark):
    cats = [(1, "Oil"), (2, "Soap"), (3, "Cream")]
    batch = [(0, 99, "Balm"), (1, None, "balm"), (2, 1, "Serum"), (3, None, "OIL"), (4, 2, "oil"), (5, 3, "soap"),
             (6, 2, "Cream"), (7, 3, "Lotion"), (8, 2, "cream"), (9, None, "Soap"), (10, 98, "soap"), (11, 3, ""),
             (12, 1, None), (13, 2, "CREAM")]
    got, names = _upsert(spark, cats, batch)
    want, final = _upsert_replay(cats, batch)
    assert got == want and got[1] is None and got[3] is None
    assert sorted(names.values()) == sorted(final.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_against_replay(spark, seed):
    rng = random.Random(seed)
    pool = [f"N{i}" for i in range(25)]
    cats = [(i, pool[i]) for i in range(12)]
    batch = [(s, rng.choice([None, None, rng.randint(0, 11), rng.randint(0, 14)]),
              rng.choice([*pool, pool[s % 25].lower(), None, "Hot", "hot", ""])) for s in range(300)]
    batch = [(s, i, n) for s, i, n in batch if not (i is None and n is None)]
    got, names = _upsert(spark, cats, batch)
    want, final = _upsert_replay(cats, batch)
    assert got == want
    assert sorted(names.values()) == sorted(final.values())


def test_empty_category_batches(spark):
    assert _upsert(spark, [(1, "a")], []) == ({}, {1: "a"})
    assert _upsert(spark, [], [(0, None, "a"), (1, None, "A"), (2, 5, "b")]) == (
        {0: None, 1: C.NAME_TAKEN, 2: C.NO_CATEGORY}, {0: "a"})


def _delete_replay(cats, used, ids):
    parents, out = dict(cats), {}
    for seq, i in sorted(ids):
        if i in [p for p in parents.values() if p is not None]:
            out[seq] = C.HAS_CHILDREN
        elif i in used:
            out[seq] = C.HAS_PRODUCTS
        elif i not in parents:
            out[seq] = C.NO_CATEGORY
        else:
            out[seq] = None
            del parents[i]
    return out, set(parents)


def _delete(spark, cats, used, ids):
    ch = C.delete_categories(spark.createDataFrame(cats, "id long, parent_id long"),
                             spark.createDataFrame([(i, u) for i, u in enumerate(used)], "id long, category_id long"),
                             spark.createDataFrame(ids, "seq long, id long").repartition(3))
    return {r["seq"]: r["error"] for r in rows(ch.outcome)}, {r["id"] for r in rows(ch.tables["categories"])}


def test_parent_goes_after_its_last_child(spark):
    cats = [(1, None), (2, 1), (3, 1), (4, 2), (5, 5), (6, 7), (7, 6), (8, None), (9, 8), (10, 77)]
    ids = [(0, 1), (1, 4), (2, 2), (3, 3), (4, 1), (5, 1), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9), (11, 8), (12, 77), (13, 10),
           (14, 77), (15, 4)]
    got = _delete(spark, cats, [3, 99], ids)
    assert got == _delete_replay(cats, {3, 99}, ids)
    got = _delete(spark, cats, [], ids)
    assert got == _delete_replay(cats, set(), ids) and got[0][4] is None and got[0][11] is None


def test_deletes_against_replay(spark):
    rng = random.Random(9)
    cats = [(i, rng.choice([None, rng.randint(0, 39)])) for i in range(40)]
    ids = [(s, rng.randint(0, 44)) for s in range(260)]
    used = {3, 17, 41}
    assert _delete(spark, cats, sorted(used), ids) == _delete_replay(cats, used, ids)
    assert _delete(spark, cats, [], []) == ({}, set(range(40)))


def test_component_roots(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] \
        + [(200, 200), (None, 201), (202, None), (300, 301), (301, 300), (300, 301)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = component_roots(spark.createDataFrame(links, "a long, b long").repartition(4))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0

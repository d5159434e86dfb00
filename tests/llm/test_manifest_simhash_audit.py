"""Merkle manifest, SimHash components and filter audit against plain loops; nulls, repeats, ties, clashing columns and empty tables included."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tollhouse.llm import audit, merkle, simhash
from tollhouse.llm.components import connected_components
from tollhouse.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([sha("".join(own[i : i + 8])) for i in range(0, len(own), 8)])
    return levels


def proof(levels, i):
    for own in levels[:-1]:
        a = i // 8 * 8
        yield "".join(own[a:i]), "".join(own[i + 1 : a + 8])
        i //= 8


def manifest(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(r)
    names = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        parts[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
    trees = [tree([leaf_of(r, r[4]) for r in parts[k]]) for k in names]
    top = tree([t[-1][0] for t in trees])
    for n, k in enumerate(names):
        for i, r in enumerate(parts[k]):
            steps = [*proof(trees[n], i), *proof(top, n)]
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            own = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4])
            for a, b in steps:
                own = sha(a + own + b)
            yield r[0], leaf_of(r, r[4]), trees[n][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), own, own == top[-1][0]


@pytest.mark.parametrize("n, langs", [(0, ["a"]), (1, ["a"]), (9, ["a"]), (70, ["a", "b", None]), (1500, ["a"] * 40 + list("bcdefghijk") + ["", "é", None])])
def test_merkle_manifest(spark, n, langs):
    dice = random.Random(n)
    rows = [(dice.choice([None, i, i, i, i, 7]), dice.choice([None, "s"]), dice.choice(langs), dice.choice([None, 3]), dice.choice([None, "", "ABc", "é Z" * 5, "low", "Q" * 9000])) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS tree", "2 AS pos", "3 AS path", "'y' AS root").repartition(3)
    found = sorted(map(tuple, merkle.verify_tampered(docs).collect()), key=repr)
    assert found == sorted(manifest(rows) if rows else [], key=repr)


def simple_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """The first place of each place's group: links of two bits or fewer, all pairs."""
    all_prints, above = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, p in enumerate(all_prints):
        for j in np.flatnonzero(np.bitwise_count(all_prints ^ p) <= 2).tolist():
            a, b = sorted((top(i), top(j)))
            above[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [simple_print(t) for _, t in docs]
    wanted = {docs[i][0]: (f"{prints[i]:016x}", docs[g][0]) for i, g in enumerate(grouped(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op12_simhash"](spark, sf).collect()} == wanted
    assert any(i != c for i, (_, c) in wanted.items())


def test_simhash_odd_rows(spark):
    texts = [None, "", " \t\n", "One", "one", "Two words", "é\x1cx y", "a b c d", "A b\tc  d", "w " * 40_000, "ÀB c d"]
    rows = [*enumerate(texts), (None, "one"), (3, "One"), (None, "alone here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS node", "4 AS least").repartition(3)
    found = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    prints = [simple_print(t) for _, t in rows]
    groups, wanted = grouped(prints), []
    for (i, _), p, g in zip(rows, prints, groups, strict=True):
        ids = [rows[j][0] for j, h in enumerate(groups) if h == g and rows[j][0] is not None]
        wanted.append((i, p, min(ids, default=None)))
    assert found == sorted(wanted, key=repr)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("bucket, block", [(2048, 1 << 15), (40, 300)])
def test_bit_sliced_buckets(spark, monkeypatch, radius, bucket, block):
    """Dense fingerprints: buckets are divided again, blocks are cut, and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", block)
    dice = random.Random(radius)
    base, whole = dice.getrandbits(64), (1 << 64) - 1
    prints = {base} | {dice.getrandbits(64) for _ in range(100)}
    for _ in range(900):
        prints.add(base ^ sum(1 << dice.randrange(64) for _ in range(dice.choice([1, 2, 3, 4, 5]))) & whole)
    near = np.array(sorted(prints), dtype=np.uint64)
    label = np.arange(len(near))
    while True:
        low = np.array([label[np.bitwise_count(near ^ p) <= radius].min() for p in near])
        if (low == label).all():
            break
        label = low
    df = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long").repartition(3)
    found = {r.node & whole: r.component & whole for r in connected_components(simhash.near_links(df, radius)).collect()}
    groups = defaultdict(set)
    for p in near.tolist():
        groups[found.get(p, p)].add(p)
    wanted = defaultdict(set)
    for p, g in zip(near.tolist(), label.tolist(), strict=True):
        wanted[g].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_filter_audit(spark):
    dice = random.Random(5)
    words = ["alpha", "beta", "GAMMA", "x$", "a|b", "é", "Tab\tbed"]
    texts = [None, "", " ", "WORD " * 60, "a b " * 40, *[" ".join(dice.choices([f"w{i}" for i in range(200)] + words, k=dice.choice([10, 49, 50, 51, 120]))) for _ in range(60)]]
    rows = [(dice.choice([None, i, i, i, i, i, i, 5]), dice.choice([None, "", "s1", "s2"]), dice.choice(texts)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS mask", "2 AS docs", "'p' AS part", "3 AS good", "4 AS hash", "5 AS rank").repartition(4)
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1])) for i in range(0, 300, 2)] + [(2, 1, 1), (None, 1, 1)]
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    kinds = Counter()
    for i, s, t in rows:
        t = t or ""
        w = t.encode().split()
        fails = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else "") + ("D" if set(t) & set("#$%&*|") else "")
        fails += "E" if t in least and (i is None or i > least[t]) else ""
        kinds[s or "", fails, i in good, i in toxic] += 1
    wanted = {}
    for part in {k[0] for k in kinds}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = {k: next((n for n, f in enumerate(order, 1) if f in k[1]), 9) for k in kinds if k[0] == part}
            for step, f in enumerate(order, 1):
                total = lambda ok: sum(n for k, n in kinds.items() if k[0] == part and ok(k, gone[k]))  # noqa: B023, E731
                removed = total(lambda k, g: g == step)
                shapley[f] += removed
                wanted[part, order, step] = [total(lambda k, g: g > step), removed, total(lambda k, g: g < step and f in k[1]), total(lambda k, g: k[1] == f), total(lambda k, g: g == step and k[2]), total(lambda k, g: g == step and k[3])]
        for (p, order, step), v in wanted.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    masked = audit.mask_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed_docs, r.redundant, r.unique_fails, r.removed_good, r.removed_toxic, r.shapley] for r in audit.audit_orders(masked, "part", ["docs", "good", "toxic"]).collect()}
    assert found == wanted
    assert audit.audit_orders(audit.mask_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "part", ["docs"]).count() == 0


def test_intervals():
    for mask, step, lo, hi in audit.intervals():
        for order in audit.ORDERS[lo:hi]:
            inside = [bool(mask >> audit.FILTERS.index(f) & 1) for f in order]
            assert inside.index(True) == step - 1
    covered = Counter()
    for mask, _, lo, hi in audit.intervals():
        covered[mask] += hi - lo
    assert covered == {m: 120 for m in range(1, 32)}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_filter_audit"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = con.sql(ORACLES[name])
    wanted = sorted(map(tuple, sql.fetchall()), key=repr)
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(*sql.columns).collect()), key=repr) == wanted

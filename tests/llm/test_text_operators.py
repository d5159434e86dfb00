"""Operators on texts against brute force: nulls, empty texts, repeats, ties, clashing columns and empty tables included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tollhouse.llm import bpe, jaccard, packing, quality, repeats, sharding, sstable, words
from tollhouse.llm.common import shared_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a  b\n\n c", "<|endoftext|> x<|endoftext|>", "it's, don't.. we'll,", "tab\there nb sp", "x\x1cy", "日本語 🙂🙂 é", "z" * 3000, "aaaa aaa\naaaaa", "Word. " * 200]


def table(spark, texts, extra=True):
    """doc_id, text and columns whose names clash with those that operators make."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "'x' AS ids", "1 AS n_bytes", "'s' AS shard", "2 AS length", "3 AS score", "4 AS kept", "5 AS row", "6 AS n")
    return df.repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE)


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe(spark, sf, tokenizer):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in bpe.encode_texts(table(spark, texts), BYTE, decoded_col="decoded").collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i].ids) == le(ids), repr(t)[:60]
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(table(spark, []), BYTE).count() == 0
    again = bpe.decode_ids(bpe.encode_texts(table(spark, texts, False), BYTE), BYTE)
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: r.decoded for i, r in got.items()}


def test_sstable(spark, tokenizer):
    rows = [(k, t) for k, t in zip([5, 5, None, -3, 9, 2, 40, 41, 42, 43, 44, 45], ODD, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = shared_dir(spark, "test")
    sstable.write_sstable(docs, out, BYTE)
    got = sorted(sstable.read_sstable(spark, out).collect(), key=lambda r: (r.shard, r.start))
    keys = [r.key for r in got]
    assert keys == [None, -3, 2, 5, 5, *sorted(k for k in keys[5:])] and len(got) == len(rows)
    wanted = sorted(le(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    assert sorted(bytes(r.ids) for r in got) == wanted
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    found = sstable.lookup_sstable(spark, out, [5, -3, None, 7]).collect()
    assert sorted(str(r.key) for r in found) == ["-3", "5", "5", "None"]
    manifest = sstable.manifest_sstable(spark, out).collect()
    assert sum(r.n for r in manifest) == len(rows) and sum(r.nulls for r in manifest) >= 1
    assert sstable.lookup_sstable(spark, out, [10**12]).count() == 0 and sstable.lookup_sstable(spark, out, []).count() == 0
    empty = shared_dir(spark, "test")
    sstable.write_sstable(docs.limit(0), empty, BYTE)
    assert sstable.read_sstable(spark, empty).count() == 0


def test_shard_blocks():
    shard = sstable.Builder(3, block_bytes=40)
    parts = []
    for k in range(50):
        if (block := shard.add(k * 3, le([k, 70_000 if k % 2 else 1]))) is not None:
            parts.append(block)
    parts += list(shard.end())
    read = sstable.Shard(b"".join(p + b"\n" for p in parts))
    assert [k for k, _, _ in read.scan()] == [3 * k for k in range(50)]
    assert [x.tolist() for x in read.get(9)] == [[3, 70_000]] and read.get(10) == [] and read.number == 3


def test_packing(spark):
    tok = Tokenizer.from_file(WORD)
    texts = [*ODD, *["many words here " * n for n in (1, 3, 100, 341, 342, 700, 2000)], *["a b c"] * 40]
    got = packing.harmonic_pack(table(spark, texts), WORD).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == le(ids) and own[0].doc_tokens == len(ids)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert sum(r.length for r in got) / len(sequences) > 0.75 * packing.CAPACITY
    assert packing.harmonic_pack(table(spark, []), WORD).count() == 0


@pytest.mark.parametrize("n", [1, 5, 64, 1000, 1500, 2047, 2048, 5000])
def test_cuts(n):
    parts = packing.cuts(n)
    assert sum(x for x, _ in parts) == n
    assert all(x * k <= 2048 and x * k >= 2048 * (1 - packing.SLACK) - k for x, k in parts)


def brute_repeats(texts, size):
    seen, raws = defaultdict(list), [(t or "").encode() for t in texts]
    for i, b in enumerate(raws):
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]].append((i, p))
    marks = [bytearray(len(b)) for b in raws]
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            marks[i][p : p + size] = b"\1" * size
    return [(i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()) for i, (b, m) in enumerate(zip(raws, marks, strict=True))]


@pytest.mark.parametrize(("size", "group", "weak"), [(400, 256, False), (70, 3, False), (70, 256, True)])
def test_repeats(spark, monkeypatch, size, group, weak):
    monkeypatch.setattr(repeats, "GROUP", group)
    if weak:
        # Ids that many texts share, and texts longer than a piece.
        monkeypatch.setattr(repeats, "text_id", lambda text: F.octet_length(text).cast("long") % 7)
        monkeypatch.setattr(repeats, "PIECE", 150)
        monkeypatch.setattr(repeats, "OFTEN", 3)
    rnd = random.Random(size)
    base = ["".join(rnd.choice("ab cdé\n") for _ in range(rnd.choice([0, size - 1, size, size + 50, 3 * size]))) for _ in range(5)]
    texts = []
    for _ in range(50):
        t = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            p = rnd.randrange(len(t) + 1)
            t = t[:p] + rnd.choice(["x", "", rnd.choice(base)[: size + 9]]) + t[p:]
        texts.append(t)
    texts += [None, "", "a" * 900, "ab" * 600, "one of its kind"]
    got = repeats.remove_repeats(table(spark, texts), threshold=size)
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert found == brute_repeats(texts, size)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_rows_of_a_common_text(spark, monkeypatch):
    """Rows of a text of very many copies do not meet in one task, and lose what the others do."""
    monkeypatch.setattr(repeats, "COMMON", 50, raising=False)
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as larger tables are joined
    held = {k: spark.conf.get(k) for k in large}
    rnd = random.Random(3)
    texts = ["a line of all " * 40] * 300 + [""] * 200 + ["two of a kind " * 40] * 2 + ["".join(rnd.choice("abcd ") for _ in range(500)) for _ in range(20)]
    texts += [texts[-1][:450] + "|", None]
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = repeats.remove_repeats(table(spark, texts)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(texts, 400)
    for a, b in ((0, 300), (300, 500)):
        assert max(Counter(r.task for r in got if a <= r.doc_id < b).values()) < (b - a) / 2


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(texts)):
        low.setdefault(root(i), i)
    return [(i, len(s), low[root(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("weak", [False, True])
def test_windows_by_bytes(monkeypatch, weak):
    """Windows whose hashes meet are told by their bytes; places beyond a context are no window, whatever bytes stand there."""
    rnd = np.random.default_rng(5)
    if weak:
        found = repeats.window_hashes
        monkeypatch.setattr(repeats, "window_hashes", lambda *a: found(*a) % np.uint64(3))
    for n in (2, 3, 9):
        rows = []
        for i in range(n):
            before, after = int(rnd.integers(0, 33)), int(rnd.integers(32, 65))
            context = bytes(rnd.integers(0, 2, before + after, dtype=np.uint8)) if i % 2 else b"\0" * (before + after)
            rows.append({"own_key": 1, "own_kind": i, "copies": 1, "low": 0, "high": 32, "before": before, "after": after, "context": context})
        windows = [{x: r["context"][r["before"] - x : r["before"] - x + 64] for x in range(33) if r["before"] >= x and r["after"] >= 64 - x} for r in rows]
        want = {(i, x) for i, own in enumerate(windows) for x, w in own.items() if any(j != i and other.get(x) == w for j, other in enumerate(windows))}
        got = {(kind, x) for _, kind, a, b in repeats._windows(rows, 64) for x in range(64 - b, 1 - a)}
        assert got == want


def test_planted_passages(spark):
    """Passages of over 50 words in documents of their own words: those of 400 bytes and more go, whole and alone."""
    rnd = random.Random(11)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(n))

    passages = [(p + "q" * 400)[:size] for p, size in ((prose(51)[:300], 399), (prose(55), 400), (prose(60), 401), (prose(90), 600))]
    texts, planted = [], []
    for i in range(24):
        passage = passages[i % 4] if i < 16 else ""
        own = chr(65 + i)  # what stands beside a passage differs, so nothing longer repeats
        texts.append(f"{prose(rnd.randint(0, 80))}{own}{passage}{own}{prose(rnd.randint(0, 80))}")
        planted.append(len(passage) if len(passage) >= 400 else 0)
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in repeats.remove_repeats(table(spark, texts)).collect())
    assert got == [(i, n, int(n > 0)) for i, n in enumerate(planted)]


@pytest.mark.parametrize(("width", "num", "den", "hot"), [(3, 9, 10, 10_000), (5, 8, 10, 10_000), (3, 9, 10, 2), (5, 8, 10, 3)])
def test_jaccard(spark, monkeypatch, width, num, den, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rnd = random.Random(width)
    voc = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(voc) for _ in range(rnd.choice([1, 2, 3, 12, 25, 40, 120]))] for _ in range(7)]
    texts = []
    for _ in range(120):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            p = rnd.randrange(len(t) + 1)
            t[p : p + rnd.choice([0, 1])] = [rnd.choice(voc)] * rnd.choice([0, 1])
        texts.append(" ".join(t).upper() if rnd.random() < 0.3 else "\t".join(t))
    texts += [None, "", "  \n", "one"]
    got = jaccard.jaccard_components(table(spark, texts), width=width, num=num, den=den)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, width, num, den)


def test_jaccard_edges(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, jaccard.jaccard_components(df).collect()))) == ["(3, 1, 3)", "(7, 2, 7)", "(7, 2, 7)", "(None, 2, 7)"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_sharding(spark):
    texts = [None, "", *["x" * n for n in range(1, 60)], "y" * 5000]
    df = table(spark, texts)
    got = sharding.assign_shards(df, limit=200).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes, counts = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.shard] += len(texts[r.doc_id] or "")
        counts[r.shard] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_docs) == (sizes[r.shard], counts[r.shard])
        assert sizes[r.shard] <= 200 or counts[r.shard] == 1
        word = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16)
        assert f"{word:032b}".startswith(r.shard)
    shards = set(sizes)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    # One key with very many equal rows is split all the same.
    same = spark.createDataFrame([(1, "z" * 50)] * 40, "doc_id long, text string")
    many = sharding.assign_shards(same, limit=200).collect()
    assert len(many) == 40 and max(r.shard_bytes for r in many) <= 200
    assert sharding.assign_shards(table(spark, [])).count() == 0


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), model, keep=["doc_id"]).withColumn("held", quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").filter("held").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert len(rows) > 30 and right / len(rows) >= 0.95
    odd = quality.score_quality(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(table(spark, ODD), None).collect()} == {0.5}


@pytest.mark.parametrize(("path", "chunker"), [(BYTE, words.spaced_chunks), (WORD, words.bare_chunks)])
def test_words_of_nul_and_full_stops(path, chunker):
    """Such a word first, last and between others: neither it nor an ending takes the other's ids."""
    tok = Tokenizer.from_file(path)
    for texts in (["a \0. \0,", "the cat. the end, \0."], ["the cat. the end,", "a \0. \0, \0.."], ["\0.", "end."]):
        memo = words.Memo(lambda xs: [le(tok.encode(x, add_special_tokens=False).ids) for x in xs], chunker, words.spaced_text if chunker is words.spaced_chunks else str)
        for t in [*texts, *reversed(texts)]:
            ids, _ = memo.batch(pa.array([t]))
            assert le(ids) == le(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_prior():
    """Positives among the unlabelled are counted without any negative label."""
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        good, bad = rng.normal(1, 1, (4000, 5)).astype("f4"), rng.normal(-1, 1, (4000, 5)).astype("f4")
        n = int(share * 4000)
        wild = np.concatenate([good[:n], bad[: 4000 - n]])
        first = quality.fit_nnpu(rng.normal(1, 1, (3000, 5)).astype("f4"), wild[::2], quality.FIRST_PRIOR)
        found = quality.estimated_prior(first.score(rng.normal(1, 1, (3000, 5)).astype("f4")), first.score(wild[1::2]))
        assert abs(found - share) < 0.06


def test_quality_of_repeated_keys(spark):
    """A key of very many rows brings one text to the fit; null keys, texts and labels do no harm."""
    docs = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 7 WHEN id > 2900 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN repeat('Good words here. ', 20) ELSE repeat('#$%', 50) END AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 5 IN (1, 2) AS INT) END AS quality")
    model = quality.fit_quality(docs, labels.unionByName(labels))
    got = {r.text: r.score for r in quality.score_quality(docs.select("text"), model).where("text IS NOT NULL").distinct().collect()}
    assert got["Good words here. " * 20] > 0.5 > got["#$%" * 50]

"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round looks all adjacent pairs up by
binary search over the sorted pair keys, takes every word's pair of lowest rank, merges that
pair wherever it stands in the word, and drops words without a pair left.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollhouse.llm import words as W

#: The vocabulary's published pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BatchedBPE:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.spelling: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.spelling[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.added.items():
            self.spelling[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for char, b in alphabet.items():
            self.of_byte[b] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.lengths = np.array([len(x) for x in self.spelling], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.spelling), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _pairs(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; ``_NONE`` where there is none or a word ends."""
        ranks = np.full(len(symbols), _NONE)
        at = np.flatnonzero(~last)
        wanted = symbols[at] * self.size + symbols[at + 1]
        found = np.searchsorted(self.keys, wanted)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == wanted
        ranks[at[hit]] = self.ranks[found[hit]]
        return ranks

    def merge(self, spelled: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, given as its bytes."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(spelled)
        sizes = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        symbols = self.of_byte[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        which = np.flatnonzero(sizes)
        sizes = sizes[which]
        while len(which):
            starts = np.cumsum(sizes) - sizes
            last = np.zeros(len(symbols), dtype=bool)
            last[starts + sizes - 1] = True
            ranks = self._pairs(symbols, last)
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == _NONE
            if done.any():
                for w, a, n in zip(which[done].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[w] = symbols[a : a + n]
                keep = np.repeat(~done, sizes)
                symbols, ranks = symbols[keep], ranks[keep]
                which, sizes, lowest = which[~done], sizes[~done], lowest[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(which):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # In a run such as "aaa" only every second place merges, counted from the left.
            fresh = np.concatenate([[True], np.diff(at) > 1])
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[at + 1] = True
            sizes = sizes - np.add.reduceat(gone, starts, dtype=np.int64)
            symbols = symbols[~gone]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; added tokens in a text are one id."""
        parts: list[list[str | int]] = []
        for text in texts:
            if self.special and "<" in text:
                part: list[str | int] = []
                for x in self.special(text):
                    part += [self.added[x]] if x in self.added else self.cut(x)
                parts.append(part)
            else:
                parts.append(self.cut(text))
        distinct = list({x for part in parts for x in part if isinstance(x, str)})
        merged = self.merge([x.encode("utf-8", "surrogatepass") for x in distinct])
        known: dict[str | int, bytes] = {x: ids.astype("<u4").tobytes() for x, ids in zip(distinct, merged, strict=True)}
        for i in self.added.values():
            known[i] = np.array([i], dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, part)) for part in parts]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of flat ids; text i has ``ids[bounds[i]:bounds[i+1]]``.  Invalid UTF-8 becomes U+FFFD."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        spelled = self.flat[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        at = ends[bounds].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


_MADE: dict[str, W.Memo] = W.held({})


def memo(path: str) -> tuple[W.Memo, BatchedBPE]:
    """This worker's encoder and its memo of words."""
    if path not in _MADE:
        bpe = BatchedBPE(path)
        _MADE[path] = W.Memo(bpe.encode, W.spaced_chunks, W.spaced_text)
        _MADE[path].bpe = bpe
    return _MADE[path], _MADE[path].bpe


def encode_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and the token ids of each whole text, as little-endian unsigned 32-bit integers.

    With ``decoded_col``, the ids are also decoded again, special tokens included.  Null and
    empty texts have no ids and decode to an empty text.  New columns replace kept ones of
    their names.  Rows are independent: repeated rows give repeated results, and an empty
    table gives an empty one.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    kept = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))
    fields = [*kept.schema.fields[:-1], T.StructField(ids_col, T.BinaryType(), False)]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType(), False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder, bpe = memo(path)
        for batch in batches:
            for a, b in W.slices(batch["__text"]):
                part = batch.slice(a, b - a)
                ids, bounds = encoder.batch(part["__text"])
                raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
                columns = [*(part[n] for n in names), pa.array([raw[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())]
                if decoded_col:
                    columns.append(pa.array(bpe.decode(ids.astype(np.int64), bounds), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that each row of ids spells; null ids give an empty text."""
    names = [c for c in df.columns if c != out]
    kept = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        _, bpe = memo(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", dtype="<u4") for x in batch[ids_col].to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            texts = bpe.decode(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(texts, pa.string())], [*names, out])

    return kept.mapInArrow(run, schema)


def op8_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the encoder and decoder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded", keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Ids of whole texts from the ids of their words, with a bounded memo in each worker.

Most of a corpus is the same words again.  Both vocabularies used here cut a text at places
that few characters decide, so the ids of a text are the ids of its chunks in order.  A
batch of texts is cut in Arrow and dictionary-encoded there; only its distinct chunks become
Python strings, and only those that the worker has not met are encoded.  The memo holds
``MEMO_CHUNKS`` chunks at most and starts anew beyond.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About 0.17 kB each.
MEMO_CHUNKS = 1_200_000
#: Longer chunks are not kept: they hardly return and fill the memo.
MEMO_CHARS = 64
#: Texts are taken together up to so many characters.
BATCH_CHARS = 4_000_000

#: Marks the first chunk of a text, which has nothing before it.
FIRST = "\r"
#: White space other than a space or newline that stands alone between other characters.
_ODD_SPACED = r"  |\n\n| \n|\n |^[ \n]|[ \n]$|^$|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Separators that Python and Arrow count as white space and Unicode does not.
_ODD_BARE = r"[\x1c-\x1f]"


def spaced_chunks(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Chunks for the byte-level pattern, which cuts before a lone space and around a lone newline.

    A chunk is a word that follows a space, which is left out, or a newline and the word
    after it; the first of a text is marked by ``FIRST``.  The second array marks texts
    with other white space, which are to be encoded whole.
    """
    odd = pc.match_substring_regex(texts, _ODD_SPACED).to_numpy(zero_copy_only=False)
    mark, none = (pa.scalar(x, texts.type) for x in (FIRST, ""))
    marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n"), none)
    return pc.split_pattern(marked, " "), odd


def spaced_text(chunk: str) -> str:
    """What a chunk of ``spaced_chunks`` stands for."""
    return chunk[1:] if chunk[0] == FIRST else chunk if chunk[0] == "\n" else " " + chunk


def bare_chunks(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """White-space separated words, for a vocabulary that drops white space."""
    odd = pc.match_substring_regex(texts, _ODD_BARE).to_numpy(zero_copy_only=False)
    return pc.utf8_split_whitespace(texts), odd


class Memo:
    """Chunk -> ids as little-endian 32-bit integers, filled by ``encode(list of strings) -> list of bytes``."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], chunker: Callable[[pa.Array], tuple[pa.ListArray, np.ndarray]], spell: Callable[[str], str] = str):
        self.encode, self.chunker, self.spell = encode, chunker, spell
        self.known: dict[str, bytes] = {"": b""}
        #: Ids of commas and full stops at the end of a word: apart from the words, any of which may stand in a text.
        self.endings: dict[str, bytes] = {}

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin (one more at the end); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists, odd = self.chunker(texts)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        met = self._ids(words)
        sizes = np.fromiter(map(len, met), dtype=np.int64, count=len(met)) // 4
        flat = np.frombuffer(b"".join(met), dtype="<u4")
        at = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lists_at = np.asarray(lists.offsets)
        per_text = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(per_text)])
        ids = flat[np.repeat(at[codes] - ends[:-1], per_text) + np.arange(ends[-1])] if len(codes) else flat[:0]
        bounds = ends[lists_at - lists_at[0]]
        if odd.any():
            where = np.flatnonzero(odd)
            whole = dict(zip(where.tolist(), self.encode([texts[int(i)].as_py() for i in where]), strict=True))
            parts = [np.frombuffer(whole[i], dtype="<u4") if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds

    def _ids(self, words: list[str]) -> list[bytes]:
        missing = [x for x in words if x not in self.known]
        if len(self.known) + len(self.endings) + len(missing) > MEMO_CHUNKS:
            self.known, self.endings = {"": b""}, {}
            missing = [x for x in words if x]
        if missing:
            self._learn(missing)
        out = list(map(self.known.__getitem__, words))
        for x in missing:
            if len(x) > MEMO_CHARS:
                self.known.pop(x, None)
        return out

    def _learn(self, missing: list[str]) -> None:
        """Letters and the commas or full stops after them never share a token, so they are looked up apart."""
        ends, cores = {}, {}
        for x in missing:
            core = x.rstrip(".,")
            if core != x and core and "a" <= core[-1] <= "z":
                ends[x] = core, x[len(core) :]
                if core not in self.known:
                    cores[core] = self.spell(core)
            else:
                cores[x] = self.spell(x)
        for end in {e for _, e in ends.values()}:
            if end not in self.endings:
                self.endings[end] = self.encode([end])[0]
        self.known.update(zip(cores, self.encode(list(cores.values())), strict=True))
        for x, (core, end) in ends.items():
            self.known[x] = self.known[core] + self.endings[end]


def slices(texts: pa.Array, chars: int = BATCH_CHARS) -> Iterable[tuple[int, int]]:
    """(start, stop) of runs of rows with about ``chars`` bytes of text each; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield at, to
        at = to


_LIBRARY: dict[tuple[str, str], Memo] = {}
_HELD: list[dict] = [_LIBRARY]


def held(memos: dict) -> dict:
    """A dictionary of this worker's memos, which ``release`` empties."""
    _HELD.append(memos)
    return memos


def release() -> None:
    """Gives up the memos of this worker, and their memory: Spark uses a worker again for stages that need it for other things."""
    held = any(_HELD)
    for memos in _HELD:
        memos.clear()
    if held:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def library_memo(path: str, chunker: Callable) -> Memo:
    """This worker's memo of a tokenizer file, encoded by the tokenizers library without special tokens."""
    if (path, chunker.__name__) not in _LIBRARY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(chunks: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(chunks), 256):
                for x in tokenizer.encode_batch_fast(chunks[at : at + 256], add_special_tokens=False):
                    out.append(np.array(x.ids, dtype="<u4").tobytes())
            return out

        _LIBRARY[path, chunker.__name__] = Memo(encode, chunker, spaced_text if chunker is spaced_chunks else str)
    return _LIBRARY[path, chunker.__name__]

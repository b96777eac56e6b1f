"""Token ids of whole texts, by an existing tokenizer file.

The vocabularies concerned drop white space and never join characters across it, so a
text's ids are those of its white-space-separated words in order. Each task encodes a
distinct word once and keeps a bounded memo; ids of texts are then gathered with array
operations. Words of ASCII and Latin-1 letters go through the tokenizer's model in bulk, cut by
array operations as its pre-tokenizer would; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import texts_for_python

#: Distinct words that a task remembers, and bytes of text that it encodes at once.
MEMO_WORDS, CHUNK_BYTES = 600_000, 4 << 20
#: Words that go to the tokenizer in one call.
WORDS_IN_CALL = 2000
#: A word with this goes through the tokenizer by itself: other characters, or what might be a special token.
ODD = r"[^\x21-\x7eÀ-ÿ]|<\|"
#: Fixed value: what the vocabulary's pre-tokenizer splits a word in lower case into.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def strings(words: pa.Array) -> list[str]:
    """The strings of an array without nulls, as Python's."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts through a tokenizer of the word-BPE kind (lower case, ``</w>`` ends a piece)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.model.model._resize_cache(0)  # parts of new words seldom come again: looking them up took a quarter of the time
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        rest = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in (10, 32, *shown)} | {b: chr(256 + i) for i, b in enumerate(rest) if b not in (10, 32)}
        self.words = pa.array([], pa.string())
        self.flat, self.starts, self.sizes, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self, most: int) -> None:
        """Keep the ids of the ``most`` words that came most often."""
        keep = np.zeros(len(self.used), bool)
        keep[np.argsort(-self.used, kind="stable")[:most]] = True
        self.words = self.words.filter(pa.array(keep))
        starts, self.sizes, self.used = self.starts[keep], self.sizes[keep], self.used[keep] // 2
        until = np.cumsum(self.sizes)
        self.flat = self.flat[np.repeat(starts - until + self.sizes, self.sizes) + np.arange(until[-1] if len(until) else 0)]
        self.starts = until - self.sizes

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def _pieces(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts of words, where each part's begin, and how many they are (an empty part has none)."""
        at = np.append(np.arange(0, len(parts), WORDS_IN_CALL), len(parts)).astype(np.int32)
        lines = strings(pc.binary_join(pa.ListArray.from_arrays(pa.array(at), parts), " "))
        shown = [x if x.isascii() else x.encode().decode("latin-1").translate(self.shown) for x in lines]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(shown, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        some = np.asarray(pc.greater(pc.binary_length(parts), 0))
        if len(stops) != some.sum():
            raise ValueError("the vocabulary doesn't end each piece of a word with </w>")
        sizes = np.zeros(len(parts), np.int64)
        sizes[some] = np.diff(stops, prepend=0)
        return ids, np.cumsum(sizes) - sizes, sizes

    def _learn(self, words: pa.Array) -> None:
        """Add words that the memo doesn't have, in an order of its own."""
        odd = pc.match_substring_regex(words, ODD)
        plain, other = words.filter(pc.invert(odd)), words.filter(odd)
        if len(plain):
            cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), PARTS, r"\0 "))
            parts = pc.list_flatten(cut).dictionary_encode()
            codes = parts.indices.to_numpy()
            real = np.asarray(pc.greater(pc.binary_length(parts.dictionary), 0))[codes]  # the cut ends in a blank: an empty part
            word = np.repeat(np.arange(len(plain)), np.diff(cut.offsets.to_numpy()))[real]
            ids, starts, sizes = self._pieces(parts.dictionary)
            codes = codes[real]
            each = sizes[codes]
            until = np.cumsum(each)
            gathered = ids[np.repeat(starts[codes] - until + each, each) + np.arange(each.sum())]
            self._add(plain, gathered, np.bincount(word, each, len(plain)).astype(np.int64))
        if len(other):
            encoded = [e.ids for e in self.whole.encode_batch_fast(strings(other), add_special_tokens=False)]
            self._add(other, np.array([i for e in encoded for i in e], np.uint32), np.array([len(e) for e in encoded], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place in them where each text starts (one more than texts)."""
        words = pc.ascii_split_whitespace(texts)
        flat, offsets = pc.list_flatten(words), words.offsets.to_numpy().astype(np.int64)
        known = pc.index_in(flat, value_set=self.words)
        missing = flat.filter(pc.is_null(known))
        new = missing.unique()
        if len(self.words) and len(self.words) + len(new) > MEMO_WORDS:
            self.forget(MEMO_WORDS // 3)
            known = pc.index_in(flat, value_set=self.words)
            missing = flat.filter(pc.is_null(known))
            new = missing.unique()
        which = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        if len(new):
            before = len(self.words)
            self._learn(new)
            which[which < 0] = before + pc.index_in(missing, value_set=self.words[before:]).to_numpy()
        self.used += np.bincount(which, minlength=len(self.used))
        sizes, starts = self.sizes[which], self.starts[which]
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(starts - until[:-1], sizes) + np.arange(until[-1])]
        return ids, until[offsets - offsets[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file; worker processes live longer than tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        until = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right"))
        yield at, max(until, at + 1)
        at = max(until, at + 1)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = None, id_type: str = "<u4", reserved: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text (no nulls) to doc_id, n_tokens and ids, as ``token_ids`` describes them."""
    own, width, most = encoder(path), np.dtype(id_type).itemsize, np.iinfo(np.dtype(id_type)).max
    for batch in batches:
        texts = batch.column(1)
        for a, b in chunks(texts):
            ids, at = own.encode(texts.slice(a, b - a))
            if end_id is not None:
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
            if len(ids) and (int(ids.max()) > most or (reserved is not None and (ids == reserved).any())):
                raise ValueError("an id is too large for its type, or is reserved")
            data = np.ascontiguousarray(ids, id_type)
            packed = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), packed], ["doc_id", "n_tokens", "ids"])


def texts_to_encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts_for_python(documents, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def token_ids(documents: DataFrame, tokenizer: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", id_type: str = "<u4", reserved: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids: little-endian unsigned 32-bit ids of each whole text, then ``end_id`` if there is one.

    A null text is the empty one. Rows stay as they are dealt; extra columns are ignored. With another
    ``id_type`` (of numpy), an id that it can't hold, or that is the ``reserved`` one, is an error.
    """
    path = tokenizer or default_tokenizer()
    return texts_to_encode(documents, id_col, text_col).mapInArrow(lambda batches: encoded(batches, path, end_id, id_type, reserved), "doc_id long, n_tokens long, ids binary")

"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is encoded before it is split: it is cut into leaves at any letter,
the leaves are encoded in parallel, and neighbours are joined up a tree.  At
each join a window around it is encoded anew; it grows until both its ends are
places that no pre-token crosses (a space after a letter that is none) and
where either side's own tokens end.  What lies outside such a window does not
depend on what lies inside, so the joined sequence is the whole encoding.

A pre-token of over LONG bytes, which has no such place, is a tree of its own:
leaves of bytes, and a window of tokens around the join grows until its first
token is the left side's and its last the right side's own.  A byte-level BPE
encoding is right exactly if each pair of neighbouring tokens is what their
joined bytes encode to, and all pairs inside the window and outside it are.

Defined cases: a null text is empty; an empty text has no tokens; very long
texts go through the tree whole; the text of a special token in a document is
that token, also where a leaf ends inside it; rows that repeat are encoded
each; an empty table gives no rows; extra columns named in `keep` are kept as
they are, but for n_tokens, ids_sha256 and decoded_sha256, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, slices, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Bytes of a pre-token from which it is cut, and of a leaf.
LONG = 4096
LEAF = 1024
#: Letters of a text from which it is cut, and of a leaf; letters of a join's first window.
LONG_TEXT = 16384
TEXT_LEAF = 8192
WINDOW = 64


class Codec:
    """One tokenizer of a process."""

    def __init__(self, vocabulary: str = VOCABULARY, long: int = LONG, leaf: int = LEAF, long_text: int = LONG_TEXT, text_leaf: int = TEXT_LEAF) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")
        self.bytes = [b""] * (max([*ranks.values(), *SPECIAL.values()]) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        for s, i in SPECIAL.items():
            self.bytes[i] = s.encode()
        self.sizes = np.array([len(b) for b in self.bytes])
        self.border = re.compile(r"(?<=\S)[ \t\n\r]")
        self.long, self.leaf, self.long_text, self.text_leaf = long, leaf, long_text, text_leaf
        # Texts' threads wait for pre-tokens' threads, so they are not the same.
        self.texts, self.pool = ThreadPoolExecutor(2), ThreadPoolExecutor(2)

    def piece(self, data: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours that are encoded each."""
        if not left or not right:
            return left + right
        w = 2
        while True:
            a, b = left[-w:], right[:w]
            window = self.piece(b"".join(self.bytes[i] for i in a + b))
            if (len(a) < w or len(a) == len(left) or window[0] == a[0]) and (len(b) < w or len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            w *= 2

    def tree(self, data: bytes) -> list[int]:
        """Encode one pre-token: leaves in parallel, then joins level by level."""
        if len(data) <= self.long:
            return self.piece(data)
        level = list(self.pool.map(self.piece, (data[i : i + self.leaf] for i in range(0, len(data), self.leaf))))
        while len(level) > 1:
            pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = list(self.pool.map(lambda p: self.join(*p), pairs)) + level[len(pairs) * 2 :]
        return level[0]

    def encode(self, text: str, unsplit: bool = True) -> np.ndarray:
        """Ids of a text.  unsplit: it may hold a long pre-token."""
        if len(text) <= self.long_text:
            return self.flat(text, unsplit)
        level = [text[i : i + self.text_leaf] for i in range(0, len(text), self.text_leaf)]
        level = list(zip(level, self.texts.map(lambda t: self.flat(t, unsplit), level)))
        while len(level) > 1:
            pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = list(self.texts.map(lambda p: self.concatenated(*p, unsplit), pairs)) + level[len(pairs) * 2 :]
        return level[0][1]

    def concatenated(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], unsplit: bool) -> tuple[str, np.ndarray]:
        """Text and ids of two neighbours that are encoded each."""
        (a, ids_a), (b, ids_b) = left, right
        w = WINDOW
        while True:
            tail = a[-w:]
            lo = max((m.start() for m in self.border.finditer(tail)), default=None)
            lo = 0 if w >= len(a) else None if lo is None else len(a) - len(tail) + lo
            found = self.border.search(b, 0, w)
            hi = len(b) if w >= len(b) else found.start() if found else None
            if lo is not None and hi is not None:
                # Tokens from the window's start on in the left side, and up to its end in the right.
                from_end = np.cumsum(self.sizes[ids_a[::-1]])
                from_start = np.cumsum(self.sizes[ids_b])
                gone, done = len(a[lo:].encode()), len(b[:hi].encode())
                i, j = (int(np.searchsorted(x, n)) + 1 if n else 0 for x, n in ((from_end, gone), (from_start, done)))
                if (not i or from_end[i - 1] == gone) and (not j or from_start[j - 1] == done):
                    return a + b, np.concatenate([ids_a[: len(ids_a) - i], self.flat(a[lo:] + b[:hi], unsplit), ids_b[j:]])
            w *= 2

    def flat(self, text: str, unsplit: bool) -> np.ndarray:
        if not unsplit:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        out: list[int] = []
        for part in self.special.split(text):
            if part in SPECIAL:
                out.append(SPECIAL[part])
            else:
                for m in self.pattern.finditer(part):
                    out += self.tree(m.group().encode())
        return np.array(out, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def unsplit_rows(texts: pa.Array, long: int) -> list[bool]:
    """Rows with `long` bytes in a row that are all white space or all not."""
    out: list[bool] = []
    for _, n, data, offsets in slices(texts):
        gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        cut = np.unique(np.concatenate([np.flatnonzero(np.diff(gap.astype(np.int8))) + 1, offsets]))
        far = np.flatnonzero(np.diff(cut) >= long)
        found = np.zeros(n, dtype=bool)
        # The row a stretch starts in; empty rows share their offset with the next.
        found[np.searchsorted(offsets, cut[far], "right") - 1] = True
        out += found.tolist()
    return out


def _encode(names: list[str], at: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch in batches:
            texts = batch.column(at)
            counts, ids_sha, text_sha, whole = [], [], [], []
            for text, unsplit in zip(texts, unsplit_rows(texts, codec.long)):
                ids = codec.encode(text.as_py() or "", unsplit)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if with_ids:
                    whole.append(ids.astype(np.int32))
            more = [pa.array(whole, pa.list_(pa.int32()))] if with_ids else []
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more], [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode_documents(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 of each row's text; with_ids: and ids."""
    small_batches(docs.sparkSession, 500)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    keep = [c for c in keep if c not in made]
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_encode(list(keep), rows.columns.index("text"), vocabulary, with_ids), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' * with_ids}")


def encode_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and its ids as an array, for files of token ids."""

    def run(batches):
        codec = once(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch in batches:
            texts = batch.column(1)
            ids = [codec.encode(t.as_py() or "", u).astype(np.int32) for t, u in zip(texts, unsplit_rows(texts, codec.long))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession, 500)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of encode_ids; null ids are none."""

    def run(batches):
        codec = once(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], dtype=np.uint32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])

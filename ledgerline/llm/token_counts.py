"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

The pieces are a public vocabulary; a piece of rank r has the score
-log(r + 1 + OFFSET), Zipf's law, so that the best segmentation of a pre-token
is a unigram model's.  A pre-token is a run of non-spaces with one space before
it, or one other white space byte.  The distinct pre-tokens of a slice go into
a trie in sorted order; each node's best score (and, on ties, fewest tokens) is
computed once from its ancestors, whichever pre-tokens share it, and a
pre-token's count is that of its terminal.  Only one path of nodes is alive.

Defined cases: null and empty texts have no tokens; a byte is always a piece,
so every text can be segmented; very long texts and pre-tokens are segmented
whole; of equal scores the fewest tokens count; rows that repeat count each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
OFFSET = 256
PRETOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
#: Distinct pre-tokens whose counts a task keeps, and the longest that are kept.
KEPT, KEPT_BYTES = 500_000, 64


def piece_scores(vocabulary: str = VOCABULARY) -> dict[bytes, float]:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 1 + OFFSET) for a, b in map(bytes.split, f)}


class PieceTrie:
    """Pieces by reversed bytes, so that a node looks back along its path."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = score


def counts_of(pretokens: list[bytes], pieces: PieceTrie) -> dict[bytes, int]:
    """Tokens of each distinct pre-token.

    Sorted order visits the trie of pre-tokens depth first; `best` and `count`
    along the present path are the forward scores of its nodes.
    """
    out: dict[bytes, int] = {}
    best, count, last = [0.0], [0], b""
    root = pieces.root
    for word in sorted(pretokens):
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for i in range(shared, len(word)):
            node, j = root, i
            top, fewest = -math.inf, 0
            while j >= 0 and (node := node.get(word[j])) is not None:
                s = node.get(-1)
                if s is not None:
                    s += best[j]
                    if s > top or (s == top and count[j] + 1 < fewest):
                        top, fewest = s, count[j] + 1
                j -= 1
            best.append(top)
            count.append(fewest)
        out[word] = count[-1]
        last = word
    return out


def _count(vocabulary: str):
    def run(batches):
        pieces = once(("pieces", vocabulary), lambda: PieceTrie(piece_scores(vocabulary)))
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = [t.as_py().encode() if t.is_valid else b"" for t in batch.column(1)]
            tokens, pretokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 21):
                    size += len(texts[j])
                    j += 1
                found = [PRETOKEN.findall(t) for t in texts[i:j]]
                new = {w for ws in found for w in ws if w not in known}
                if len(known) + len(new) > KEPT:
                    known = {}
                    new = {w for ws in found for w in ws}
                counts = counts_of(list(new), pieces)
                long = {w: c for w, c in counts.items() if len(w) > KEPT_BYTES}
                known.update(counts)
                for n, ws in enumerate(found):
                    pretokens[i + n] = len(ws)
                    tokens[i + n] = sum(map(known.__getitem__, ws))
                for w in long:
                    del known[w]
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pretokens), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row."""
    small_batches(docs.sparkSession, 1000)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(vocabulary), "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

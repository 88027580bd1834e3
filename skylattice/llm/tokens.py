"""Token counts by section, from one encoding of the whole document.

The whole text is encoded once.  Token byte lengths give every token's span in the text; sections
are the text's lines, a line owning the line feed that ends it; an interval join by binary search in
the sorted bounds puts tokens in sections.  A token over a boundary belongs, by rule:
- `first`: to the section of its first character;
- `most`: to the section with most of its bytes, the first among equals;
- `share`: to each section by its share of the token's bytes.
Under every rule a document's sections add up to its tokens.

Defined results: null text counts as empty; an empty text is one empty section; bytes that are no UTF-8
count as the replacement character, in tokens, lines and characters alike; repeated rows each get their
sections.  A result column whose name the id has is named with an underscore before it.  An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, map_texts, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that goes with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHARED: dict = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """(encoding, token byte lengths), built once in a worker."""
    key = hash((vocabulary, pattern))
    if key not in _SHARED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(k) for k in ranks]
        _SHARED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _SHARED[key]


# Fixed value: what the pattern takes for white space.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile(f"[{BLANK}]{{4096,}}")


def encoded(enc, text: str) -> np.ndarray:
    """Token ids of the whole text.

    The pattern goes back over a run of white space as far as it is long, so long runs are encoded apart: all
    of one but its last character is one piece under the pattern, and all of it where the text ends.
    """
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(enc.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        out.append(blank_piece(enc, text[run.start() : end].encode()))
        at = end
    return np.concatenate([np.asarray(x, np.int64) for x in (*out, enc.encode_to_numpy(text[at:], disallowed_special=()))])


def blank_piece(enc, piece: bytes) -> list[int]:
    return enc._encode_single_piece(piece)


def attribute(size: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens begun) by section; size: token bytes, bounds: section starts and the end, in bytes."""
    n = len(bounds) - 1
    stop = np.cumsum(size)
    start = stop - size
    first = np.searchsorted(bounds[1:-1], start, "right")
    last = np.searchsorted(bounds[1:-1], np.maximum(stop - 1, start), "right")
    out = np.bincount(first, minlength=n).astype(np.float64)
    over = np.flatnonzero(last > first)
    cross = np.bincount(first[over], minlength=n)
    if rule != "first":
        for t in over:
            parts = np.arange(first[t], last[t] + 1)
            held = np.minimum(stop[t], bounds[parts + 1]) - np.maximum(start[t], bounds[parts])
            out[first[t]] -= 1
            if rule == "share":
                out[parts] += held / size[t]
            else:
                out[parts[held.argmax()]] += 1
    return out, cross


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """A row a section: (id, section, start_char, end_char, n_tokens, n_crossing)."""
    if rule not in ("first", "most", "share"):
        raise ValueError(f"no rule {rule}")
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    whole = rule != "share"

    def run(texts):
        enc, size = encoder(held.value)
        rows, cols = [], [[] for _ in range(5)]
        for i, t in enumerate(texts):
            text = t.decode("utf-8", "replace")
            raw = np.frombuffer(text.encode(), np.uint8)  # what is encoded and what is cut are the same bytes
            ids = encoded(enc, text)
            bounds = np.r_[0, np.flatnonzero(raw == 10) + 1, len(raw)]
            if len(bounds) > 2 and bounds[-2] == len(raw):
                bounds = bounds[:-1]
            chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][bounds]
            n, cross = attribute(size[ids], bounds, rule)
            rows.append(np.full(len(n), i))
            for c, x in zip(cols, (np.arange(len(n)), chars[:-1], chars[1:], n.astype(np.int64) if whole else n, cross), strict=True):
                c.append(x)
        return np.concatenate(rows), [pa.array(np.concatenate(c)) for c in cols]

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.LongType() if whole else T.DoubleType(), T.LongType())
    names = [fresh(x, [id_col]) for x in ("section", "start_char", "end_char", "n_tokens", "n_crossing")]
    return map_texts(docs, text_col, [id_col], [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], run, one_to_one=False)


def op1_token_counts(spark, sf_dir):
    return section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))

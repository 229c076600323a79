"""Token counts by field and section, from one encoding of the whole document.

The fields of a document are joined and encoded once; nothing is encoded again field by field. A byte-level
vocabulary gives tokens whose bytes are the text's, so each token has an exact span of UTF-8 bytes. Spans are joined
to the intervals of the sections, and tokens that cross a border are allocated by a rule:

- ``start``: to the section of the token's first byte;
- ``majority``: to the section with most of its bytes, the earlier one of a tie;
- ``fraction``: to all its sections in proportion to their bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import combined

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str):
    """(encode, bytes of each token id) for lines of a base64 token and its rank."""
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, r in ranks.items():
        sizes[r] = len(t)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def allocate(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Tokens of each section. ``sizes``: bytes of the tokens in order; ``starts``: first byte of each section, ascending, the first 0."""
    out = np.zeros(len(starts))
    if not len(sizes):
        return out
    end = np.cumsum(sizes)
    begin = end - sizes
    real = np.flatnonzero(np.diff(np.r_[starts, total]) > 0)  # empty sections get nothing
    bounds = starts[real]
    a, z = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(bounds, end - 1, "right") - 1
    if rule == "start":
        np.add.at(out, real[a], 1)
        return out
    np.add.at(out, real[a[a == z]], 1)
    for i in np.flatnonzero(a != z):
        s = np.arange(a[i], z[i] + 1)
        share = np.minimum(np.r_[bounds, total][s + 1], end[i]) - np.maximum(bounds[s], begin[i])
        if rule == "fraction":
            out[real[s]] += share / sizes[i]
        else:
            out[real[s[np.argmax(share)]]] += 1
    return out


def token_counts(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", sections_of: str | None = None, rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN, separator: str = "\n") -> DataFrame:
    """One row per document, field and section: id, field, section, n_tokens, n_bytes, total (tokens of the whole document).

    The text that is encoded is the ``fields`` (null: empty) joined by ``separator``, which counts to the field before
    it. The sections of the field ``sections_of`` are its lines, each with its line break; other fields are one
    section. Empty sections have no bytes and no tokens, and the counts of a document add up to its total.
    n_tokens is a double for the rule ``fraction``, else a long. The vocabulary file is read where this is called
    (a megabyte or so) and broadcast.
    """
    if rule not in ("start", "majority", "fraction"):
        raise ValueError(f"no such rule: {rule}")
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))
    glue = separator.encode()
    whole = rule != "fraction"

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size_of = encoder(shared.value, pattern)
        for part in parts:
            for batch in (part.slice(i, 200) for i in range(0, part.num_rows, 200)):
                owner, field, section, tokens, sizes, totals = [], [], [], [], [], []
                columns = [combined(batch, f"f{i}").to_pylist() for i in range(len(fields))]
                for r in range(batch.num_rows):
                    starts, at = [], 0
                    for i, name in enumerate(fields):
                        raw = columns[i][r].encode() + (glue if i < len(fields) - 1 else b"")
                        inner = [0]
                        if name == sections_of:
                            inner += [int(x) + 1 for x in np.flatnonzero(np.frombuffer(columns[i][r].encode(), np.uint8) == 10)]
                        starts += [at + x for x in inner]
                        field += [name] * len(inner)
                        section += range(len(inner))
                        at += len(raw)
                    ids = encode(separator.join(c[r] for c in columns))
                    counts = allocate(size_of[np.array(ids, np.int64)], np.array(starts, np.int64), at, rule)
                    owner += [r] * len(starts)
                    tokens.append(counts)
                    sizes.append(np.diff(np.r_[starts, at]))
                    totals += [len(ids)] * len(starts)
                amounts = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays(
                    [combined(batch, "id").take(pa.array(owner)), pa.array(field, pa.string()), pa.array(section, pa.int32()), pa.array(amounts.astype(np.int64) if whole else amounts), pa.array(np.concatenate(sizes), pa.int64()), pa.array(totals, pa.int64())],
                    names=["id", "field", "section", "n_tokens", "n_bytes", "total"],
                )

    schema = T.StructType([rows.schema["id"], T.StructField("field", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("n_tokens", T.LongType() if whole else T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("total", T.LongType())])
    return rows.mapInArrow(count, schema)

"""Operator 8, token counts per section by offset-mapped attribution.

A document is encoded once as a whole.  The tokens of a byte-level vocabulary are the text's bytes in order, so a token's
place follows from the lengths of the tokens before it.  The token spans are interval-joined to the sections (here
lines, each with the newline that ends it; any list of boundaries will do).  A token that crosses a boundary goes by an
explicit rule: "first" (the section of its first byte, the default), "last", or "most" (the section that holds most of
its bytes, the earlier one on a tie).  Section counts therefore add up to the document's count under every rule.

The vocabulary file's path is a parameter.  Both lists are sorted, so the join is a binary search in the task that has
the document; nothing is shuffled.

Defined results: a null or empty text has one section without tokens; every row gives its own sections, repeated rows
too; strings that look like control tokens are ordinary text; extra columns are ignored; an empty table gives an empty
result.  A text on which the encoder's splitter gives up (a run of some hundred thousand blanks) is cut only where the pattern
always breaks, at both ends of its long runs, so it has the tokens of the whole document.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Long runs of what the pattern's \s stands for.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_LOADED: dict = {}


def _encoder(path: str | None):
    """The encoder and the length of each token in bytes, read once per task."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _LOADED[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}), size
    return _LOADED[path]


def _around_runs(encoding, text: str) -> list[int]:
    """The tokens of a text, its long runs of blanks taken past the splitter: but for a last blank before other
    characters, which goes with these, a run is one piece of the pattern."""
    ids, at = [], 0
    for run in _RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    return ids + encoding.encode_ordinary(text[at:])


def token_ends(text: str, path: str | None = None) -> np.ndarray:
    """Where each token ends, in bytes."""
    encoding, size = _encoder(path)
    try:
        ids = encoding.encode_ordinary(text)
    except BaseException as e:  # the splitter's panic is not an Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        ids = _around_runs(encoding, text)
    return np.cumsum(size[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Where each line ends, in bytes; a last line without a newline ends with the text."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_end: np.ndarray, section_end: np.ndarray, rule: str = "first") -> np.ndarray:
    """Number of tokens in each section; both lists hold ascending ends over the same bytes."""
    start = np.concatenate([[0], token_end[:-1]]) if len(token_end) else token_end
    first = np.searchsorted(section_end, start, "right")
    if rule == "first":
        owner = first
    elif rule == "last":
        owner = np.searchsorted(section_end, token_end - 1, "right")
    elif rule == "most":
        owner = first.copy()
        for t in np.flatnonzero(np.searchsorted(section_end, token_end - 1, "right") > first):
            cuts = section_end[(section_end > start[t]) & (section_end < token_end[t])]
            owner[t] += int(np.argmax(np.diff(np.concatenate([[start[t]], cuts, [token_end[t]]]))))
    else:
        raise ValueError(f"unknown rule {rule}")
    return np.bincount(owner, minlength=len(section_end))


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens: a row for each line of each document."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int64()),
                        ("char_end", pa.int64()), ("n_tokens", pa.int64())])

    def counted(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            ids, reps = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                ends = line_ends(raw)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
                ids.append(doc_id)
                reps.append(len(ends))
                for col, v in zip(cols, (np.arange(len(ends)), np.concatenate([[0], chars[:-1]]), chars,
                                         attribute(token_ends(text, path), ends, rule))):
                    col.append(v)
            if ids:
                whole = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), reps)))
                yield pa.RecordBatch.from_arrays(
                    [whole, *[pa.array(np.concatenate(c), f.type) for c, f in zip(cols, list(schema)[1:])]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        counted, "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

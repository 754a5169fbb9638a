"""Sizes of documents in tokens of a public tokenizer, counted once per document over whole texts."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file (byte-level BPE ranks), and the folder of tokenizers; both are parameters of every operator.
TOKENIZER, FOLDER = "byte_bpe_50k.tiktoken", "/opt/tokenizers"
STEP = 512
#: Texts are encoded in stretches cut at white space of about this length, so that one very long text needs no long-running merge.
STRETCH = 20_000
#: Sentences that ask, or stand behind a question mark sign, are prompts and bear no loss.
_PROMPT = re.compile(r"^\s*(?:Q:|Question:|User:)|\?[\"')\]]*\s*$")
_SENT = re.compile(r"(?<=[.!?])\s+|\n+")

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The encoding of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + STRETCH // 2, at + STRETCH)
        cut = cut if cut > at else at + STRETCH
        yield text[at:cut]
        at = cut
    yield text[at:]


def count(text: str | None, enc) -> tuple[int, int]:
    """(tokens, loss-bearing tokens) of a whole text; null has none. Prompt sentences bear no loss."""
    if not text:
        return 0, 0
    total = sum(len(enc.encode_ordinary(s)) for s in stretches(text))
    asked = [s for s in _SENT.split(text) if _PROMPT.search(s)] if "?" in text or "Q" in text else []
    prompt = sum(len(enc.encode_ordinary(p)) for s in asked for p in stretches(s))
    return total, max(total - prompt, 0)


def document_sizes(documents: DataFrame, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """(doc_id, keep..., tokens, loss_tokens), one row per non-null ``doc_id`` (of repeated rows the longest).

    Texts are counted where they lie; only ids and numbers are exchanged.
    """
    path = f"{folder}/{tokenizer}"
    inner = documents.where("doc_id is not null").select("doc_id", *keep, F.col("text").alias("__text"))
    kept = inner.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                got = [count(t, enc) for t in b.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [*(f.name for f in kept), "tokens", "loss_tokens"])

    sized = inner.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["tokens bigint", "loss_tokens bigint"]))
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "loss_tokens", *keep)).alias("x")).select("doc_id", *[f"x.{c}" for c in (*keep, "tokens", "loss_tokens")])

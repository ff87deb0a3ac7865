"""Token ids of a whole corpus by a public byte-level tokenizer.

Method: tiktoken with a local rank file. Long texts are cut beforehand at positions where the
tokenizer's own pattern always starts a new piece, so the ids are those of the whole text while
no single call sees an unbounded string. Decoding works on raw bytes: a token may end inside a
character, so bytes are joined first and read as UTF-8 once.

Cases: a null or empty text gives an empty list of ids; a blank text gives the ids of its white
space; strings that look like special tokens are ordinary text; other columns are ignored except
the id, which is kept as it is, so repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-splitting pattern published with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A piece with a letter never continues into a non-letter, and no piece holds white space after
# anything else; both positions therefore start a piece whatever stands around them.
_SAFE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\S)(?=\s)")

_encodings: dict[str, object] = {}


def default_rank_file() -> str:
    """Path of byte_bpe_50k.tiktoken, overridable by QUILLSTONE_TOKENIZERS."""
    folder = os.environ.get("QUILLSTONE_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def encoding(rank_file: str):
    """The tokenizer of ``rank_file``, loaded once per Python process."""
    if rank_file not in _encodings:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encodings[rank_file] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_file]


def safe_pieces(text: str, limit: int) -> list[str]:
    """``text`` in parts of about ``limit`` characters, cut only where a piece always starts."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if found is None or found.start() >= len(text):
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


def encode_text(text: str | None, rank_file: str, limit: int = 65_536) -> list[int]:
    if not text:
        return []
    enc = encoding(rank_file)
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in safe_pieces(text, limit):
        out += enc.encode_ordinary(part)
    return out


def decode_ids(ids: list[int], rank_file: str) -> str:
    """Text of ``ids``: the tokens' bytes joined, then decoded once."""
    enc = encoding(rank_file)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encode(df: DataFrame, text: str = "text", id_col: str = "doc_id", rank_file: str | None = None, limit: int = 65_536) -> DataFrame:
    """(id, ids): ids is the list of token ids of the text, without special tokens."""
    rank_file = rank_file or default_rank_file()
    kept = df.select(F.col(id_col).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            ids = [encode_text(t, rank_file, limit) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def token_counts(df: DataFrame, text: str, keep: list[str], rank_file: str | None = None) -> DataFrame:
    """Columns ``keep`` and n_tokens, the length of the text's ids; no list of ids is built up in Spark."""
    rank_file = rank_file or default_rank_file()
    kept = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            n = [len(encode_text(t, rank_file)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, n_tokens long")

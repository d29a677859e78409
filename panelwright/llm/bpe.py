"""Byte-level BPE encoding and decoding (operator 1).

Ids come from a local rank file through the tiktoken library. A text longer than `PIECE` characters is cut at safe
boundaries first, places where every match of the pre-splitting pattern ends whatever follows, so that the ids equal
those of the whole text while memory stays bounded by the piece, or by a single match of the pattern if that is longer (a run
of letters, or of marks, without a break), which no cut may divide. Ids are carried as packed little-endian unsigned
32-bit integers, the form in which token files are stored; decoding gives raw bytes, which need not be valid UTF-8.

Defined results: a NULL or empty text has no ids and decodes to no bytes; repeated rows are encoded each; other
columns pass through unless they are named `ids` or `decoded`, which the result replaces; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import all_of, small_batches, table, unused

#: Characters after which a text is cut at the next safe boundary.
PIECE = 1 << 16
#: No match of the pattern holds a letter or digit and a blank or mark after it, nor a letter beside a digit.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n]|[^\s\p{L}\p{N}])|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts that are encoded alike apart or together."""
    start = 0
    while len(text) - start > most:
        if not (found := SAFE.search(text, start + most)):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer, loaded once in each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(text: str | None, enc, most: int = PIECE) -> bytes:
    return b"".join(np.array(enc.encode_ordinary(x), dtype="<u4").tobytes() for x in pieces(text, most)) if text else b""


def unpack(ids: bytes | None, enc, most: int = PIECE) -> bytes:
    if not ids:
        return b""
    found = np.frombuffer(ids, dtype="<u4")
    return b"".join(enc.decode_bytes(found[i : i + most].tolist()) for i in range(0, len(found), most))


def _mapped(df: DataFrame, source: str, target: str, keep: list[str], each) -> DataFrame:
    """df[keep] with a binary column made of another column, batch by batch."""
    small_batches(df.sparkSession)
    keep = [c for c in keep if c != target]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(target, T.BinaryType())])
    sent = list(dict.fromkeys([*keep, source]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = pa.array([each(x.as_py()) for x in part.column(sent.index(source))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), made], names=[*keep, target])

    return df.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """The columns `keep` (all but the text, unless named) and `ids`, packed little-endian unsigned 32-bit token ids."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return _mapped(df, text, "ids", keep, lambda x: pack(x, encoding(ranks_path, pattern), piece))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, unless named) and `decoded`, the raw bytes of the ids."""
    return _mapped(df, ids, "decoded", df.columns if keep is None else keep, lambda x: unpack(x, encoding(ranks_path, pattern)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = encode(docs.select("doc_id", "text"), ranks_path, pattern, keep=["doc_id"])
    measured = coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    back = decode(measured, ranks_path, pattern, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs without the text, its token ids (packed as described above), their number, and whether decoding gives the text's bytes back."""
    import public_tokenizers

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    # The other columns travel as one, so that none of their names can meet those of the encoder.
    row = F.struct(F.lit(0).alias(unused(others, "_")), *all_of(others)).alias("row")
    packed = docs.select("text", row, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    back = decode(encode(packed, *args, keep=["row", "digest"]), *args)
    return back.select(*(F.col("row").getField(c).alias(c) for c in others), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))

"""Problem 6: the whole corpus as token ids of a public byte-level BPE.

A text of more than ``chunk`` characters is encoded as overlapping chunks. A cut between two chunks is found by
pre-tokenising the overlap from two different starts: where both have a boundary at the same place they have
resynchronised, and a boundary there does not depend on what came before. Both neighbours of a cut see the same
overlap, so they agree on it. What lies from cut to cut is encoded; the ids strung together are those of the whole text.

The chunks of a text of up to ``spread`` characters stay in one task, without a shuffle; those of a longer one are spread over
tasks. Texts of one chunk are encoded as they are.

Results for odd input:
  * null and empty texts give an empty list of ids, blank texts the ids of their blanks;
  * strings that look like special tokens are ordinary text;
  * where an overlap holds no boundary (one letter run longer than it), there is no cut, and a text that is spread over tasks is
    encoded in one;
  * several rows with one id each give their own row, unless the text is long: ``doc_id`` is taken to be unique;
  * no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Characters of a chunk, how far neighbours look across a cut, and characters from which chunks are spread over tasks.
CHUNK, OVERLAP, SPREAD = 1 << 10, 1 << 7, 1 << 18

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """The encoder of a rank file; one a worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def resync(window: str, at: int) -> int | None:
    """The first place at or after ``at`` where pre-tokenising from 0 and from ``at`` have both a boundary.

    The place must lie before the end of the window, so that the token that ends there was not cut short, and not
    behind white space, which is split by what follows it.
    """
    if at == 0:
        return 0
    a = {m.end() for m in _pattern().finditer(window)} | {0}
    for m in _pattern().finditer(window, at):
        if m.end() >= len(window):
            return None
        if m.end() in a and not window[m.end() - 1].isspace():
            return m.end()
    return None


def _ids(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in lists], dtype=np.int64)
    values = np.concatenate(lists) if lists else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def cuts(text: str, chunk: int, overlap: int) -> list[int]:
    """Where the chunks of a text begin and end."""
    out = [0]
    for at in range(chunk, len(text), chunk):
        c = resync(text[at - overlap : at + overlap], overlap)
        if c is not None:
            out.append(at - overlap + c)
    return [*out, len(text)]


def _encode_local(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """Every text in one task, chunk by chunk."""

    def one(enc, text: str | None) -> np.ndarray:  # noqa: ANN001
        if not text:
            return np.array([], np.int32)
        if len(text) <= chunk:
            return np.asarray(enc.encode_ordinary(text), dtype=np.int32)
        at = cuts(text, chunk, overlap)
        return np.concatenate([np.asarray(enc.encode_ordinary(text[a:b]), dtype=np.int32) for a, b in zip(at, at[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                got = [one(enc, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _ids(got)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def _encode_chunks(chunks: DataFrame, id_col: str, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """Rows of (id, no, last, piece): ``piece`` reaches ``overlap`` beyond the chunk on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            got, ok = [], []
            for no, last, piece in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                head = overlap if no else 0  # where this chunk begins in the piece
                tail = head + chunk  # where the next begins
                start = resync(piece[: head + overlap], head)
                end = len(piece) if last else resync(piece[tail - overlap : tail + overlap], overlap)
                end = end + tail - overlap if end is not None and not last else end
                good = start is not None and end is not None
                got.append(np.asarray(enc.encode_ordinary(piece[start:end]), dtype=np.int32) if good else np.array([], np.int32))
                ok.append(good)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), _ids(got)], names=[id_col, "no", "ok", "ids"])

    return chunks.mapInArrow(run, f"`{id_col}` {chunks.schema[id_col].dataType.simpleString()}, no int, ok boolean, ids array<int>")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(id, ids) of every row of ``docs``."""
    if overlap * 2 > chunk:
        raise ValueError("the overlap may be half a chunk at most")
    vocabulary = vocabulary or default_vocabulary()
    n = F.length(text_col)
    short = _encode_local(docs.where(n.isNull() | (n <= spread)), id_col, text_col, vocabulary, chunk, overlap)
    # chunks that are worth a task of their own
    chunk, overlap = max(chunk, spread), max(overlap, min(spread // 2, 1 << 12))
    at = F.col("no") * chunk
    begin = F.greatest(at - overlap, F.lit(0))
    chunks = (
        docs.where(n > spread)
        .select(id_col, F.col(text_col).alias("__text"), F.explode(F.sequence(F.lit(0), F.ceil(F.length(text_col) / chunk).cast("int") - 1)).alias("no"))
        .select(id_col, "no", (at + chunk >= F.length("__text")).alias("last"), F.substring("__text", begin + 1, at + chunk + overlap - begin).alias("piece"))
    )
    # spread the chunks of one text over the tasks before Python sees them
    pieces = materialize(_encode_chunks(chunks.repartition(F.xxhash64(id_col, "no")), id_col, vocabulary, chunk, overlap), "pieces")
    if not pieces.limit(1).count():
        return short
    stuck = pieces.where("not ok").select(id_col).distinct()
    long = (
        pieces.join(stuck, id_col, "left_anti")
        .groupBy(id_col)
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda p: p["ids"])).alias("ids"))
    )
    whole = _encode_local(docs.where(n > spread).join(stuck, id_col, "left_semi"), id_col, text_col, vocabulary, chunk, overlap)
    return short.unionByName(long).unionByName(whole)


def chunks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunks): of how many pieces the ids of each text are strung together; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(cuts(t, chunk, overlap)) - 1 if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[id_col, "chunks"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, chunks int")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the bytes of the ids strung together. Null ids give a null text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")

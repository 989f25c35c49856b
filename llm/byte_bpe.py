"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before they meet the regex engine, only at places that no match of the pattern
spans, so the ids are those of the whole text: (a) before white space that follows a word character
(no alternative takes white space after other characters), and (b) before the last white space of a
run that a word character follows (the run but its last character is one match). A run of white
space too long for the regex engine is one match and is merged as one piece.
Decoding joins the bytes of the ids; no text layer is involved, so ids that split a character decode too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from llm.common import documents, strings

#: Texts beyond this many characters are cut at safe places.
SLICE_CHARS = 1 << 16
#: Pure white space beyond this goes to the merges without the regex.
RUN_CHARS = 1 << 14

_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n\t])|(?<=[ \n\t])(?=[ \n\t][0-9A-Za-z])")
#: The characters with Unicode's White_Space property, which are the pattern's white space.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Cut at the first safe place at or after every ``size`` characters; all parts joined are the text."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found or found.start() == len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of the whole text, without special tokens."""
    if len(text) <= RUN_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in slices(text):
        done = 0
        for run in _RUN.finditer(part):
            # one match: the run, but its last character if others follow
            stop = run.end() if run.end() == len(part) else run.end() - 1
            ids.extend(enc.encode_ordinary(part[done : run.start()]))
            ids.extend(enc._encode_single_piece(part[run.start() : stop]))
            done = stop
        ids.extend(enc.encode_ordinary(part[done:]))
    return ids


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def byte_bpe(df: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of (doc_id, text): number and digest of the ids, digest of the decoded bytes; the ids too if asked.

    A null or empty text has no ids and the digests of nothing. Rows are independent of each other:
    repeated rows and null ids come back as they are, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            count, id_digest, text_digest, all_ids = [], [], [], []
            for text in strings(batch.column("text")):
                ids = encode(enc, text)
                count.append(len(ids))
                id_digest.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_digest.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(id_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []),
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
            )

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, ids): the raw bytes. Null or empty ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = [decode(enc, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.common import table

    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

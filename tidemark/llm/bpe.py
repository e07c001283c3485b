"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the token ids of every whole text and, on request, the bytes
they decode to.  Each match of the split pattern is merged on its own and
special tokens are never recognised, as the tiktoken library does for ordinary
text.

Long texts are cut before tiktoken sees them, at places where the split
pattern always ends a match whatever stands around them: before a space that
follows a character which is not white space.  Very long runs of white space
are taken out and merged as the single piece that the pattern makes of them.

Null text encodes as empty text: no ids, no bytes.  Existing columns with the
output names are replaced.  Other columns and row order within a task stay.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.textcore import attach

#: Characters of a text that are given to the library at once.
CHUNK = 50_000
#: A run of white space from this length on is merged apart from the pattern's matches.
LONG_SPACE = 2_000

# Every character that any of the engines counts as white space.
_SPACE = r"\s\x1c-\x1f\x85"
_RUN = re.compile(rf"[{_SPACE}]{{{LONG_SPACE},}}")
_CUT = re.compile(rf"(?<=[^{_SPACE}]) ")


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, content.splitlines()))}


@functools.lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(content), special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of text that encode alone to the ids they have within the text."""
    a, n = 0, len(text)
    while n - a > size:
        m = _CUT.search(text, a + size)
        if not m:
            break
        yield text[a : m.start()]
        a = m.start()
    if a < n:
        yield text[a:]


def _plain(enc: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    return [enc.encode_to_numpy(c, disallowed_special=()) for c in chunks(text)]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Token ids of a whole text."""
    if len(text) <= LONG_SPACE:
        return enc.encode_to_numpy(text, disallowed_special=())
    out, a = [], 0
    for m in _RUN.finditer(text):
        run = m.group()
        if any(c in "\x1c\x1d\x1e\x1f" for c in run):
            continue  # not white space to the pattern; left to the library
        # The pattern gives all but the last character of a run to one match
        # (the last one leads the next word), or the whole run at a text's end.
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += _plain(enc, text[a : m.start()])
        out.append(np.asarray(enc._encode_single_piece(text[m.start() : stop].encode()), np.uint32))
        a = stop
    out += _plain(enc, text[a:])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with ``ids_col`` (array of int) and, if asked for, ``decoded_col`` (the bytes of those ids).

    The driver reads the rank file (some MB at most) and ships its content with
    the task, so executors need no copy of it.
    """
    with open(ranks_path, "rb") as f:
        content = f.read()
    outputs = T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        outputs.add(decoded_col, T.BinaryType(), False)

    def work(batch, texts):
        enc = codec(content, pattern)
        ids = [encode_text(enc, texts.bytes(i).decode()) for i in range(len(texts))]
        made = [_lists(ids)]
        if decoded_col:
            made.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
        return made

    return attach(df, text_col, outputs, work)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the bytes of each array of ids; a null array, or one with an unknown id, gives null."""
    with open(ranks_path, "rb") as f:
        content = f.read()
    from tidemark.llm.textcore import tune, without

    tune(df.sparkSession)
    df = without(df, [decoded_col])
    schema = T.StructType([*df.schema.fields, T.StructField(decoded_col, T.BinaryType())])

    def run(batches):
        enc = codec(content, pattern)
        for b in batches:
            made = []
            for ids in b.column(b.schema.get_field_index(ids_col)).to_pylist():
                try:
                    made.append(None if ids is None else enc.decode_bytes(ids))
                except (KeyError, OverflowError, TypeError):
                    made.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offs[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))

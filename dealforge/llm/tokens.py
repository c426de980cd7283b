"""Token counts: whole texts, cut at boundaries that no merge crosses, encoded in batches.

A text is cut where one space stands between two characters that are neither spaces nor the
library's own mark for one. No piece of the
vocabulary has a space mark after another character (checked when the model is loaded), and
the library writes a space mark before each text that it is given, so the cut space is not
lost and the counts of the parts add up to the count of the whole. Parts recur, so each
worker keeps a bounded memo of their counts and encodes only new ones. Texts are taken in slices
balanced by bytes, the new parts of a slice are encoded together in batches balanced by bytes, and
a text longer than a slice is taken in stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import chunks

MEMO_PARTS = 400_000
BATCH_BYTES = 1 << 20
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
_LOADED: dict[str, tuple] = {}


def cut(text: str) -> list[str]:
    if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
        return _CUT.split(text)
    return text.split(" ")


def stretches(text: str, size: int) -> Iterator[str]:
    """A long text in stretches of about `size`, cut where cut() would."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        yield text[at : found.start() if found else len(text)]
        at = found.end() if found else len(text)


def _load(path: str) -> tuple:
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        _LOADED[path] = (model, {}, not any("▁" in p.lstrip("▁") for p in pieces))
    return _LOADED[path]


def _encode(model, parts: list[str], memo: dict[str, int]) -> None:
    start = size = 0
    for stop, part in enumerate([*parts, None]):
        if part is None or size >= BATCH_BYTES:
            batch = parts[start:stop]
            memo.update(zip(batch, map(len, model.encode(batch, num_threads=1))))
            start, size = stop, 0
        size += len(part or "") * 2


def token_counter(path: str):
    """A function from texts to token counts, for use inside tasks."""
    model, memo, safe = _load(path)

    def count(texts: list[str | None]) -> list[int]:
        if not safe:
            return [len(model.encode(t or "", num_threads=1)) for t in texts]
        if len(memo) > MEMO_PARTS:
            memo.clear()
        parts = [cut(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in memo]
        _encode(model, new, memo)
        out = [sum(map(memo.__getitem__, own)) for own in parts]
        for p in new:
            if len(p) > 200:  # not worth a place in the memo
                del memo[p]
        return out

    return count


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes and 0 tokens. Rows with null or repeated ids stay as
    they are. Other columns, whatever their names, are left out. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(model_path)
        for b in batches:
            texts = b.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = []
            for some in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), size=BATCH_BYTES):
                found = some.column(0).to_pylist()
                if len(found) == 1 and found[0] and len(found[0]) > BATCH_BYTES and _load(model_path)[2]:
                    tokens.append(sum(count([s])[0] for s in stretches(found[0], BATCH_BYTES)))
                else:
                    tokens += count(found)
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    out = picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

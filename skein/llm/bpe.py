"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text of more than LEAF characters is cut into halves, these into halves again, wherever that falls, down to
leaves of at most LEAF. The leaves of all texts in hand are encoded in one batch, which the library spreads over its
threads. Then the halves are joined up the tree: around each join a window is encoded anew and grown until it shares a
token, at the same place, with the left side and one with the right side. A sequence of tokens is the encoding of its
text if every adjacent pair is, and in the spliced sequence every adjacent pair stands in one of three exact encodings,
so the result is exact. Joins of one level are done together, their windows in one batch.

Defined cases: a null text is empty; an empty text has no tokens and decodes to itself; special token strings inside a
text become their ids, as in the library, also where a cut falls into one; texts of any length and without any break
are read whole; repeated rows each give a row; an empty table gives an empty one; columns of the input other than the
id and the text are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import small_batches

#: Most characters of a leaf, and characters on each side of a join in its first window.
LEAF, WINDOW = 2048, 48


class Codec:
    """One tokenizer file: encode by tree concatenation, decode by its byte table."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"] for t in spec["added_tokens"]}
        # characters before an end within which what follows may still change where the pattern splits
        self.margin = max([3, *(len(t["content"]) for t in spec["added_tokens"])])
        visible = self._visible()
        self.bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if i in added else bytes(visible[c] for c in token)
        self.sizes = [*map(len, self.bytes)]

    @staticmethod
    def _visible() -> dict[str, int]:
        """Byte-level vocabularies write byte b as a printable character: itself, or one from 256 on."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cuts = [self._halves(len(t)) for t in texts]
        flat = iter(self._plain([t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in zip(c, c[1:])]))
        levels = [[(a, b, next(flat)) for a, b in zip(c, c[1:])] for c in cuts]
        while True:
            joins = [(t, level[i], level[i + 1]) for t, level in zip(texts, levels, strict=True) for i in range(0, len(level) - 1, 2)]
            if not joins:
                return [level[0][2] for level in levels]
            joined = iter(self._join(joins))
            levels = [[(level[i][0], level[i + 1][1], next(joined)) for i in range(0, len(level) - 1, 2)] or level for level in levels]

    def _halves(self, n: int) -> list[int]:
        """Limits of the leaves of a text of n characters: halves of halves, as many for every part."""
        k = 1
        while k * self.leaf < n:
            k *= 2
        return [n * i // k for i in range(k + 1)]

    def _join(self, joins: list[tuple]) -> list[list[int]]:
        """Encodings of neighbouring stretches, (text, (a, cut, ids), (cut, b, ids)) each, spliced into one."""
        out: list[list[int] | None] = [None] * len(joins)
        open_, reach = [*range(len(joins))], self.window
        while open_:
            limits = [(max(joins[i][1][0], joins[i][1][1] - reach), min(joins[i][2][1], joins[i][1][1] + reach)) for i in open_]
            windows = self._plain([joins[i][0][low:high] for i, (low, high) in zip(open_, limits, strict=True)])
            for i, (low, high), ids in zip(open_, limits, windows, strict=True):
                out[i] = self._splice(*joins[i], low, high, ids)
            open_ = [i for i in open_ if out[i] is None]
            reach *= 2
        return out  # type: ignore[return-value]

    def _splice(self, text: str, one: tuple, two: tuple, low: int, high: int, ids: list[int]) -> list[int] | None:
        """Left tokens, window, right tokens, if the window agrees with both sides; a side that it covers is not needed."""
        (first, cut, left), (_, last, right) = one, two
        size, where, at = self.sizes, {}, -len(text[low:cut].encode())
        begin = at
        for k, t in enumerate(ids):  # places in bytes, counted from the join
            where[at] = k
            at += size[t]
        i = k = 0
        if low > first:
            place, sure = 0, -len(text[cut - self.margin : cut].encode()) if cut - self.margin >= low else begin - 1
            for i in range(len(left) - 1, -1, -1):
                place -= size[left[i]]
                if place < begin:
                    return None
                k = where.get(place, -1) if place <= sure else -1
                if k >= 0 and ids[k] == left[i]:
                    break
            else:
                return None
        m, j = len(ids), len(right)
        if high < last:
            place, sure, agreed = 0, len(text[cut : high - self.margin].encode()) if high - self.margin >= cut else -1, False
            for n, t in enumerate(right):
                if place > sure:
                    break
                w = where.get(place, -1)
                if w >= k and ids[w] == t:
                    m, j, agreed = w, n, True
                place += size[t]
            if not agreed:
                return None
        return left[:i] + ids[k:m] + right[j:]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that the ids stand for; a broken sequence becomes replacement characters."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each row's tokens: id, n_tokens, digests of the ids and of the decoded text, and the ids if wanted.

    tokenizer is the path of a file in the format of the tokenizers library, readable on all executors.
    """
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    arrow = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                group, total = [], 0
                while at + len(group) < len(texts) and total < 1 << 18:
                    group.append(texts[at + len(group)].as_py() or "")
                    total += len(group[-1])
                counts, shas, backs, kept = [], [], [], []
                for ids in own.encode(group):
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    backs.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(group)), pa.array(counts, pa.int64()), pa.array(shas), pa.array(backs), *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], schema=arrow)
                at += len(group)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

"""Best-fit packing by the sum-of-squares rule.

Documents become pieces of at most ``capacity`` tokens; a piece goes to the
open sequence (or a new one) for which the sum over gaps g of N(g)^2 becomes
smallest, N(g) being the number of open sequences with g tokens left. Pieces
are dealt evenly into packing groups whose number grows with the input, and
each group is packed in one task, larger pieces first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.common import staged, text_or_empty

CAPACITY = 2048
GROUP_PIECES = 1 << 15      # pieces packed by one task
KNOWN_PARTS = 200_000       # parts of text a worker remembers during a task
LONGEST_KNOWN = 64          # characters of such a part at most
JOINED = 2_000              # words encoded in one string
# Fixed value: the pre-tokenizer pattern for which texts may be taken apart here
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts of printable ASCII (but "<", which may begin a special token), accented Latin letters, spaces and line
# ends; and what the pattern above finds in them once they are in lower case
_FAMILIAR = re.compile(r"[ \n!-;=-~À-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \na-z0-9ß-öø-ÿ]+").findall
_known: dict = {}
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a worker for each core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _tokenizers[path] = tok
    return _tokenizers[path]


def _known_kind(tok) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits by SPLITS."""
    kind = json.loads(tok.to_str())
    steps = [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", [])]
    split = ((kind["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return (steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": SPLITS}
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].startswith("<|") for t in kind["added_tokens"]))


def _ids(numbers: list[int]) -> bytes:
    out = array("I", numbers)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _PartIds(dict):
    """Ids of a part, by the tokenizer's model. Parts in use stay known: when
    half the room is full the parts known so far step back, and those met again return."""

    def __init__(self, tok) -> None:
        self.model, self.old = tok.model, {}
        # the model wants letters beyond ASCII byte by byte, as the pre-tokenizer writes them
        accented = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
        self.by_bytes = str.maketrans({c: tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in accented})

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = _ids([t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.by_bytes))])
        if len(part) <= LONGEST_KNOWN:
            if len(self) >= KNOWN_PARTS // 2:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


def _familiar_ids(text: str, known: _PartIds) -> bytes:
    parts = _PARTS(text.lower())
    return b"".join(itemgetter(*parts)(known)) if len(parts) > 1 else b"".join([known[x] for x in parts])


def _word_ids(words: list[str], tok) -> dict[str, bytes]:
    """Ids of each word by the whole tokenizer, many words at a time."""
    out: dict[str, bytes] = {}
    groups = [words[at:at + JOINED] for at in range(0, len(words), JOINED)]
    for at in range(0, len(groups), 8):
        some = groups[at:at + 8]
        for group, e in zip(some, tok.encode_batch([" ".join(x) for x in some], add_special_tokens=False), strict=True):
            raw = _ids(e.ids)
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.offsets))     # place of each token
            cuts = (4 * np.searchsorted(first, np.cumsum([0, *(len(w) + 1 for w in group)]))).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(group, cuts, cuts[1:]))
    return out


def encode_bytes(texts: list[str], path: str, end_id: int = 0) -> list[bytes]:
    """Ids of each text and the end id, as little-endian 32-bit numbers.

    A tokenizer of the known kind drops white space and none of its tokens
    holds a space, so the ids of a text are those of its parts, one after the
    other. Texts of familiar characters are parted here, and each distinct part is
    encoded once; of other texts the unfamiliar words go through the whole
    tokenizer. Any other tokenizer encodes whole texts."""
    tok, end = _tokenizer(path), int(end_id).to_bytes(4, "little")
    if path not in _known:
        _known[path] = _PartIds(tok) if _known_kind(tok) else None
    known = _known[path]
    if known is None:
        return [_ids(e.ids) + end for e in tok.encode_batch_fast(list(texts), add_special_tokens=False)]
    split = {i: t.replace("\n", " ").split(" ") for i, t in enumerate(texts) if not _FAMILIAR(t)}
    odd = _word_ids([w for w in set().union(*split.values()) if not _FAMILIAR(w)], tok)
    return [b"".join([odd[w] if w in odd else _familiar_ids(w, known) for w in split[i]]) + end if i in split
            else _familiar_ids(t, known) + end for i, t in enumerate(texts)]


def forget() -> None:
    """Drops what a worker remembers of the texts it encoded."""
    _known.clear()


def _pieces(path: str, capacity: int, with_ids: bool):
    def cut(batches):
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            at = 0
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and (end == at or size < 1 << 20):
                    size += len(texts[end].as_py())
                    end += 1
                out = {"take": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
                for k, raw in enumerate(encode_bytes(texts.slice(at, end - at).to_pylist(), path)):
                    for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                        cut = raw[4 * start:4 * (start + capacity)]
                        out["take"].append(at + k)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(cut) // 4)
                        out["crc"].append(zlib.crc32(cut))
                        if with_ids:
                            out["ids"].append(np.frombuffer(cut, dtype="<u4").astype("int32"))
                cols = [ids.take(pa.array(out["take"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                at = end

    def run(batches):
        try:
            yield from cut(batches)
        finally:
            forget()        # workers serve other tasks afterwards
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): whole documents where they fit, else cuts of ``capacity``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return (docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
            .mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema))


def place_sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order.

    Moving a sequence from gap g to g - w changes the sum of squares by
    2 (N(g-w) - N(g)) + 2, or by 1 - 2 N(g) if it becomes full (full ones do
    not count); a new one adds 2 N(capacity-w) + 1, or nothing if full at
    once. Ties go to the smallest gap."""
    n = np.zeros(capacity + 1, dtype=np.int64)          # N by gap; N(0) stays 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    big = np.int64(1) << 60
    for i, w in enumerate(lengths.tolist()):
        left = n[w:capacity + 1]
        change = np.where(left > 0, 2 * (n[:capacity + 1 - w] - left) + 2, big)
        if left[0]:
            change[0] = 1 - 2 * left[0]
        g = int(change.argmin())
        fresh = 0 if w == capacity else 2 * int(n[capacity - w]) + 1
        if change[g] <= fresh and change[g] < big:
            gap = w + g
            b = bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        seq[i], off[i] = b, capacity - gap
        if gap > w:
            n[gap - w] += 1
            bins[gap - w].append(b)
    return seq, off


def _pack_group(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["__row"].to_numpy(), -pdf["length"].to_numpy()))
        pdf = pdf.iloc[order]
        seq, off = place_sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf = pdf.assign(sequence_id=seq + (np.int64(key[0]) << 32), offset=off)
        return pdf.drop(columns=["__group", "__row"])
    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (with a ``length`` column of 1 to capacity) with ``sequence_id`` and ``offset``.

    ``parts`` must be a stored table: rows are dealt to groups by their place
    in it, so groups are even whatever the ids look like and the same when a
    task runs again."""
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = (parts.withColumn("__row", F.monotonically_increasing_id())
             .withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("long")))
    schema = T.StructType([*parts.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("__group").applyInPandas(_pack_group(capacity), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * a null or empty text is the end id alone (one piece of length 1);
    * only documents over ``capacity`` are cut, the last piece may be shorter;
    * repeated rows are packed as often as they stand in the table;
    * an empty table gives an empty result; other columns are ignored.
    """
    parts = staged(pieces(docs, tokenizer_path, capacity, with_ids, id_col, text_col), "pieces")
    return pack(parts, capacity, group_pieces)

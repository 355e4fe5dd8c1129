"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ by e edits and still count. Split into
e + 1 pieces, at least one piece of a match is then untouched, so every match
shows as an exact piece hit. Hits are found for all items at once by one
automaton per task, and around each hit Myers' bit-parallel algorithm takes
the edit distance of the item to the best-matching stretch of the document.

Items and texts are compared as words (runs of letters and digits, lower
case) with one space between, so punctuation, case and line ends never hide a
match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.llm.common import staged

ERROR_SHARE = 0.05          # edits allowed per character of the item
BLOCK_CHARS = 1 << 20       # characters of items that one automaton holds (about 60 MB in a worker)
_GAP = re.compile(r"[^\w ][\W_]*|_[\W_]*| [\W_]+")     # what is not one space already
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text).strip().lower()


def budget(n: int, share: float = ERROR_SHARE) -> int:
    return int(n * share)


def split_item(text: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n, k = len(text), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item as bit masks, for distances to stretches of a text."""

    def __init__(self, text: str):
        self.n = len(text)
        self.mask = self._masks(text)
        self.back = self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def _best(self, masks: dict[str, int], text: str, anchored: bool) -> tuple[int, int]:
        """(least distance of the whole item to a stretch that ends at e, e); stretches start anywhere or at 0."""
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        best = (self.n, 0)
        for e, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            plus, minus = (down | ~(xh | up)) & full, up & xh
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus = plus << 1 | anchored
            up = (minus << 1 | ~(xv | plus)) & full
            down = plus & xv & full
            if score < best[0]:
                best = (score, e)
        return best

    def find(self, text: str) -> tuple[int, int, int]:
        """(distance, start, end) of the stretch of ``text`` nearest to the item."""
        distance, end = self._best(self.mask, text, False)
        again, back = self._best(self.back, text[:end][::-1], True)
        return distance, end - back, end


class Matcher:
    """All items of one block: automaton over their pieces, patterns, budgets."""

    def __init__(self, items: list[tuple], share: float):
        import ahocorasick
        self.items, pieces = [], {}
        for item_id, text in items:
            words = normal(text)
            if words:
                errors = budget(len(words), share)
                for offset, piece in split_item(words, errors):
                    pieces.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, words, errors, Pattern(words)))
        self.auto = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.auto.add_word(piece, (len(piece), places))
        if pieces:
            self.auto.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str | None) -> list[tuple]:
        """(item id, distance, errors allowed, start, end) in the normal form of ``text``."""
        if not text or not self.any:
            return []
        words = normal(text)
        near: dict[int, list[int]] = {}
        for last, (size, places) in self.auto.iter(words):
            for item, offset in places:
                near.setdefault(item, []).append(last + 1 - size - offset)
        out = []
        for item, starts in near.items():
            item_id, pattern_text, errors, pattern = self.items[item]
            n = len(pattern_text)
            if errors == 0:
                out += [(item_id, 0, 0, s, s + n) for s in starts if _at_words(words, s, s + n)]
                continue
            starts.sort()
            at = 0
            while at < len(starts):             # hits whose windows overlap are looked at together
                end = at + 1
                while end < len(starts) and starts[end] - starts[end - 1] <= 2 * errors:
                    end += 1
                lo = max(0, starts[at] - errors)
                distance, a, b = pattern.find(words[lo:starts[end - 1] + n + errors])
                if distance <= errors:
                    out.append((item_id, distance, errors, lo + a, lo + b))
                at = end
        return sorted(set(out), key=lambda m: (m[3], m[4], str(m[0])))


def _at_words(text: str, a: int, b: int) -> bool:
    return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal form as code-point spans of the text."""
    norm, at = [], 0
    for m in _WORD.finditer(text):
        size = len(m.group().lower())
        norm.append((at, at + size, m.start(), m.end()))
        at += size + 1
    out = []
    for a, b in spans:
        hit = [w for w in norm if w[1] > a and w[0] < b]
        if not hit:
            out.append((0, 0))
            continue
        first, last = hit[0], hit[-1]
        out.append((min(first[3], first[2] + max(0, a - first[0])), min(last[3], last[2] + b - last[0])))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars``, one at a time: each is one bounded broadcast and one pass."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _scan(items, share: float):
    made: list[Matcher] = []

    def run(batches):
        if not made:
            made.append(Matcher(items.value, share))
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if found := made[0].find(text):
                    spans = original_spans(text, [(m[3], m[4]) for m in found])
                    rows += [(m[0], m[1], m[2], *s) for m, s in zip(found, spans, strict=True)]
                    take += [i] * len(found)
            kinds = [None, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take, pa.int64())), *cols],
                                             ["doc_id", "item_id", "distance", "allowed", "start", "stop"])
    return run


def contaminated_spans(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per match: doc_id, item_id, distance, allowed, start, stop (code points of the text).

    * null texts and items, and items without a letter or digit, match nothing;
    * an item too short for an edit must stand as whole words;
    * of overlapping places of one item the nearest is reported; different
      items, repeated items and repeated rows are each reported;
    * empty tables give an empty result; other columns are ignored; documents
      are read whole, once per block of items (one block up to 1 M characters).
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id].dataType)])
    for name, kind in (("distance", "integer"), ("allowed", "integer"), ("start", "long"), ("stop", "long")):
        schema = schema.add(name, kind)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(items, item_id, item_text, block_chars)):
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), share), schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def is_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = ERROR_SHARE,
                    item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> Column:
    """True where a text holds a test item: for filters that keep the rows as they are. For items of several
    blocks prefer :func:`without_items`, which holds one block at a time."""
    spark, out = docs.sparkSession, F.lit(False)
    for block in item_blocks(items, item_id, item_text, block_chars):
        out = out | _holds_item(spark.sparkContext.broadcast(block), share)(F.col(text_col).cast("string"))
    return out


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = ERROR_SHARE,
                  item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text holds no test item, as they are.

    Each block of items is one pass over the rows still kept; between two
    passes these are written to the shared folder, so a worker holds the
    automaton of one block only. Null texts stay; no items, no change."""
    spark, blocks = docs.sparkSession, item_blocks(items, item_id, item_text, block_chars)
    out, block = docs, next(blocks, None)
    while block is not None:
        out = out.where(~_holds_item(spark.sparkContext.broadcast(block), share)(F.col(text_col).cast("string")))
        block = next(blocks, None)
        if block is not None:
            out = staged(out, "decontaminated")
    return out


def _holds_item(shared, share: float):
    made: list[Matcher] = []

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(shared.value, share))
        return pd.Series([bool(made[0].find(t)) for t in texts], dtype=bool)

    return hit

"""Personal data by a semi-Markov conditional random field.

Candidate segments (whole spans, at most ``MAX_SPAN`` characters) are scored
by features of the span as a unit and of its surroundings; dynamic
programming over the segments of a neighbourhood chooses boundaries and types
jointly. Places that match a base pattern are always reported; the field adds
secrets (keys, tokens, passwords), which no pattern delimits.

The field is trained here, on a bounded sample of segments from the corpus:
base matches carry their kind, and runs named as a key, token, password or
secret right before them are secrets; other runs are nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]                # base kinds, in the order of the report
TYPES = [*KINDS, "secret"]
MAX_SPAN = 512          # characters of an added span
TRAIN_ROWS = 4_000      # neighbourhoods that the weights are fitted on
GAP = 24                # characters between segments of one neighbourhood

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive forms of the base patterns: a run is taken whole or not at all
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[A-Za-z0-9_+/=.-]+")
_RUN_CHARS = _LOCAL - frozenset("%") | frozenset("/=")
_NAMED = re.compile(r"(?:pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth|bearer|key)[\"']?\s*[:=]?\s*[\"']?$", re.I)


def luhn(digits: str) -> bool:
    s = sum(map(int, digits[-1::-2]))
    return (s + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _EMAIL_TAIL.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns: (kind, start, end), by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _runs(text: str):
    """Runs of key characters that hold a digit: digits are rare, so they are looked for first."""
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() >= done:
            a = m.start()
            while a > done and text[a - 1] in _RUN_CHARS:
                a -= 1
            done = _RUN.match(text, m.start()).end()
            if done - a >= 8:
                yield a, done


def segments(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Candidate segments (start, end, base type or -1), by end; none longer than MAX_SPAN."""
    found = {(a, b): TYPES.index(k) for k, a, b in base if b - a <= MAX_SPAN}
    for a, b in _runs(text):
        run = text[a:b].strip(".=-_/+")
        a += text[a:b].find(run) if run else 0
        for x, y in {(a, a + len(run)), *((a + v.start(1), a + v.end(1)) for v in re.finditer(r"(?:^|[=.:/])([A-Za-z0-9_+-]{8,})", run))}:
            if 8 <= y - x <= MAX_SPAN and any(c in "0123456789" for c in text[x:y]) and (x, y) not in found:
                found[x, y] = -1
    return sorted(((a, b, t) for (a, b), t in found.items()), key=lambda s: (s[1], s[0]))


N_FEATURES = 20


def features(text: str, a: int, b: int) -> np.ndarray:
    """Whole-span features: shape, alphabet, entropy, and the words before."""
    s, f = text[a:b], np.zeros(N_FEATURES)
    n = b - a
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isascii() and c.isalpha() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    entropy = -sum((k := s.count(c) / n) * math.log2(k) for c in set(s))
    turns = sum((x in "0123456789") != (y in "0123456789") for x, y in zip(s, s[1:]))
    f[:] = (1, min(n, 64) / 32, n >= 16, n >= 32, digits / n, letters / n, hexes == n, digits == n, "@" in s, s.count(".") == 3 and digits + 3 == n,
            s[0] == "+", entropy / 4, entropy > 3, turns / n, turns >= 4, any(c.islower() for c in s) and any(c.isupper() for c in s),
            bool(_NAMED.search(text, max(0, a - 24), a)), a > 0 and text[a - 1] in "=\"':", a > 0 and text[a - 1].isalnum() or b < len(text) and text[b].isalnum(),
            any(c in " ()-" for c in s))
    return f


def neighbourhoods(text: str) -> list[list[tuple[int, int, int]]]:
    """Segments in groups that stand within GAP characters of each other: one chain each."""
    out: list[list] = []
    end = -GAP - 1
    for seg in sorted(segments(text, base_spans(text))):
        if seg[0] - end > GAP:
            out.append([])
        out[-1].append(seg)
        end = max(end, seg[1])
    return [sorted(g, key=lambda s: (s[1], s[0])) for g in out]


class Field:
    """Weights: type x feature for segments, type x type (and start) for neighbours; "nothing" scores 0."""

    def __init__(self, w: np.ndarray | None = None, v: np.ndarray | None = None):
        t = len(TYPES)
        self.w = np.zeros((t, N_FEATURES)) if w is None else w
        self.v = np.zeros((t + 1, t)) if v is None else v      # last row: no entity before

    @staticmethod
    def _before(chain) -> list[int]:
        """For each segment, how many end where it starts or earlier; chains come sorted by end, so these are the first ones."""
        ends = [b for _, b, *_ in chain]
        return [bisect.bisect_right(ends, a) for a, *_ in chain]

    def log_partition(self, chain, x: np.ndarray):
        """Forward scores (segment x type), their total, and the segments that can stand before each."""
        score = x @ self.w.T
        before = [range(n) for n in self._before(chain)]
        alpha = np.empty_like(score)
        for i in range(len(chain)):
            into = [self.v[-1]] + [alpha[j][:, None] + self.v[:-1] for j in before[i]]
            alpha[i] = score[i] + np.logaddexp.reduce(np.vstack(into), axis=0)
        return alpha, np.logaddexp.reduce(np.append(alpha.ravel(), 0.0)), before

    def gradient(self, chain, x: np.ndarray, gold: list[tuple[int, int]]):
        """Of the log-likelihood of the gold (segment, type) path."""
        alpha, z, before = self.log_partition(chain, x)
        score = x @ self.w.T
        beta = np.zeros_like(alpha)
        gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
        for i in reversed(range(len(chain))):
            after = [k for k in range(i + 1, len(chain)) if i in before[k]]
            stay = [np.zeros((len(TYPES), 1))] + [self.v[:-1] + (score[k] + beta[k])[None, :] for k in after]
            beta[i] = np.logaddexp.reduce(np.hstack(stay), axis=1)
        for i in range(len(chain)):
            gw -= np.exp(alpha[i] + beta[i] - z)[:, None] * x[i]
            out = score[i] + beta[i] - z
            gv[-1] -= np.exp(self.v[-1] + out)
            for j in before[i]:
                gv[:-1] -= np.exp(alpha[j][:, None] + self.v[:-1] + out[None, :])
        last = -1
        for i, t in gold:
            gw[t] += x[i]
            gv[last, t] += 1
            last = t
        return gw, gv

    def decode(self, chain, x: np.ndarray) -> list[tuple[int, int]]:
        """The best (segment, type) path; segments of a path do not overlap."""
        score = x @ self.w.T
        n, t = score.shape
        best, back = np.empty((n, t)), [[None] * t for _ in range(n)]
        # best path of the first m segments by the type of its last one: (n + 1) x t scores and segments
        top, at = np.full((n + 1, t), -np.inf), np.zeros((n + 1, t), np.int64)
        for i, m in enumerate(self._before(chain)):
            step = top[m][:, None] + self.v[:-1]
            for k in range(t):
                p = int(step[:, k].argmax())
                best[i, k], back[i][k] = (step[p, k], (int(at[m, p]), p)) if step[p, k] > self.v[-1, k] else (self.v[-1, k], None)
            best[i] += score[i]
            better = best[i] > top[i]
            top[i + 1], at[i + 1] = np.where(better, best[i], top[i]), np.where(better, i, at[i])
        i, k = divmod(int(best.argmax()), t)
        if best[i, k] <= 0:
            return []
        path = [(i, k)]
        while back[i][k] is not None:
            i, k = back[i][k]
            path.append((i, k))
        return path[::-1]


def _sample(batches):
    """Neighbourhoods as JSON-like rows: hash, features, starts, ends, gold types."""
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            for g in neighbourhoods(text or ""):
                if len(g) > 32:
                    continue                    # a bounded sample: lists of hundreds of items are left to prediction
                x = np.array([features(text, a, e) for a, e, _ in g])
                gold = [t if t >= 0 else (len(TYPES) - 1 if _NAMED.search(text, max(0, a - 24), a) else -1) for a, e, t in g]
                key = hashlib.sha1(text[g[0][0]:g[-1][1]].encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((key, x.ravel().tolist(), [a for a, _, _ in g], [e for _, e, _ in g], gold))
        kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "x", "a", "b", "gold"])


def train(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS, rounds: int = 6, seed: int = 7) -> Field:
    """Fit the field on at most ``rows`` neighbourhoods of the corpus (those with the smallest content hash)."""
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _sample, "key string, x array<double>, a array<long>, b array<long>, gold array<long>")
    field, data = Field(), []
    for r in found.dropDuplicates(["key"]).orderBy("key").limit(rows).collect():
        chain = list(zip(r.a, r.b, r.gold, strict=True))
        gold, end = [], -1
        for i, (a, b, t) in enumerate(chain):   # of overlapping labels the first stays
            if t >= 0 and a >= end:
                gold.append((i, t))
                end = b
        x = np.array(r.x).reshape(len(chain), -1)
        # the name before a secret is what labelled it: half the time it is hidden, so that the span itself is learned
        data.append((chain, x, gold))
    rng, step = np.random.default_rng(seed), 0.3
    for k in range(rounds):
        for i in rng.permutation(len(data)):
            chain, x, gold = data[i]
            if rng.random() < 0.5:
                x = x.copy()
                x[:, 16] = 0
            gw, gv = field.gradient(chain, x, gold)
            rate = step / (1 + k)
            field.w += rate * (gw - 1e-4 * field.w)
            field.v += rate * (gv - 1e-4 * field.v)
    return field


def find_spans(text: str | None, field: Field) -> tuple[list, list]:
    """(base spans, all spans), each (kind, start, end) by start, then kind."""
    base = base_spans(text) if text else []
    added = []
    for g in neighbourhoods(text) if text else []:
        if any(t < 0 for _, _, t in g):
            x = np.array([features(text, a, b) for a, b, _ in g])
            added += [("secret", g[i][0], g[i][1]) for i, t in field.decode(g, x)
                      if TYPES[t] == "secret" and not any(a < g[i][1] and g[i][0] < b for _, a, b in base)]
    return base, sorted([*base, *added], key=lambda s: (s[1], TYPES.index(s[0]), s[2]))


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _run(model):
    def run(batches):
        field = Field(*model.value)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base, every = find_spans(text, field)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return run


def pii_spans(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    * null text counts as empty: no spans, the digest of the empty list;
    * base spans of different kinds may overlap and all stay; added spans
      never overlap a base span;
    * repeated rows each get the same row; an empty table an empty result
      (the untrained field adds nothing); other columns are ignored;
    * texts are read whole; positions are code points, ends exclusive.
    """
    field = field or train(docs, text_col, train_rows)
    model = docs.sparkSession.sparkContext.broadcast((field.w, field.v))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run(model), schema)

"""Secret scan: fixed credential patterns plus values in credential contexts
whose guess cost is high.

The guess cost of a value is the smallest total over all its segmentations
(dynamic programming over end positions) into words, dates, repeats, keyboard
walks or sequences, and brute-force spans; every segment costs the decimal
logarithm of the guesses an attacker needs for it.  ``hunter2`` splits into a
word and a digit and stays cheap; ``x9$Lq2!vT`` can only be brute-forced, and so
can letters that are no words.  Words are priced by their rank in a public
tokenizer's vocabulary.  No value is cut short; places that already cost
``MIN_COST`` are not carried further, so a value of a megabyte takes as long as
finding its repeats and walks.

Spans are code-point offsets, end exclusive.  The patterns run over whole
texts inside one Arrow-batched map: no shuffle, nothing gathered.

Defined cases: null and empty text have no spans; repeated rows give the same
spans; other columns are carried along by ``redact`` and not read otherwise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, open_table, replace_column

KINDS = ("assign", "access", "hex", "guess")
#: log10 guesses from which a value in a credential context counts as secret.
MIN_COST = 8.0
MASK = "[SECRET]"

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

# Credential contexts for the guess cost: "<name> = value" (also <name>_key, <name>_access_key, <name>_id), "<name> is value",
# "scheme://user:value@host" and "Bearer value".
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[\x20_-]?key|credentials?|login|pin)"""
    r"""(?:[_-](?:access|secret|private|api|auth|key|id|token|value|hash|[0-9]{1,3})){0,4}"""
    r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|was)\x20*:?\x20*)["'`]?([^\s"'`,;<>()\[\]{}]{6,})"""
    r"""|[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]{6,})@"""
    r"""|(?<![A-Za-z0-9])bearer\x20+([A-Za-z0-9._~+/=-]{6,})""", re.A | re.I)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "pin", "://", "bearer")

# Frequent words in passwords, most frequent first.
COMMON_WORDS = (
    "password pass the you love admin user test welcome login hello monkey dragon master qwerty "
    "letmein football baseball princess sunshine shadow michael jordan super hunter killer secret "
    "summer winter spring autumn flower orange purple yellow silver golden cookie banana cheese "
    "chocolate computer internet server database system root guest default change example sample "
    "demo temp home office money lucky happy angel baby sweet star batman superman pokemon thomas "
    "george daniel andrew charlie robert jessica ashley nicole soccer hockey tennis tiger lion eagle "
    "horse house black white green blue red one two three and for with this that not key value "
    "company service account private public production staging client"
).split()


def default_lexicon() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def word_ranks(path: str) -> tuple[dict[str, int], int]:
    """Ranks of words, and their greatest length: the frequent password words,
    then the whole words (three ASCII letters or more after a blank) of a public
    tokenizer's vocabulary in its order, which follows frequency."""
    ranks = {w: k for k, w in enumerate(COMMON_WORDS, 1)}
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            word = base64.b64decode(token)
            if word[:1] == b" " and len(word) > 3 and word[1:].isalpha() and word.isascii():
                ranks.setdefault(word[1:].decode().lower(), len(COMMON_WORDS) + int(rank))
    return ranks, max(map(len, ranks))


_LEET = str.maketrans("@4310$5!7", "aaelossit")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Row of every ASCII key (-1: none) and its column in half keys; letters and digits.
_KEY_ROW, _KEY_COLUMN = np.full(128, -1), np.zeros(128, int)
for _r, _row in enumerate(_ROWS):
    for _k, _c in enumerate(_row):
        _KEY_ROW[ord(_c)], _KEY_COLUMN[ord(_c)] = _r, 2 * _k + _r
_ALNUM = np.array([chr(_k).isalnum() for _k in range(128)])
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
                   r"|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
_YEAR = re.compile(r"(?:19|20)\d\d")
_SEGMENT = 0.3                     # every further segment makes the order uncertain


@lru_cache(maxsize=256)
def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33) if c.isascii() else 3.0


class _Steps:
    """Steps between neighbouring characters: which are one kind of move, and
    up to where a walk from any place goes on."""

    def __init__(self, moves: np.ndarray):
        """``moves``: a code of the step after each character, 0 for none."""
        self.breaks = np.flatnonzero(moves == 0)
        self.turns = np.append(0, np.cumsum((moves[1:] != moves[:-1]) & (moves[1:] != 0) & (moves[:-1] != 0)))
        self.n = len(moves)

    def walk(self, at: int) -> tuple[int, int]:
        """(end of the characters, turns) of the longest walk from ``at``."""
        k = np.searchsorted(self.breaks, at)
        last = int(self.breaks[k]) if k < len(self.breaks) else self.n     # first place without a step
        if last <= at:
            return at + 1, 0
        return last + 1, int(self.turns[last - 1] - self.turns[at])


class _Value:
    """The cheap segments of a value, found from any start without walking the
    rest of the value again."""

    def __init__(self, value: str, lexicon: str | None):
        low = value.lower()
        if len(low) != len(value):                  # lower case may be longer outside ASCII
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.value, self.low, self.plain = value, low, low.translate(_LEET)
        self.ranks, self.longest = word_ranks(lexicon or default_lexicon())
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.differ = [np.flatnonzero(codes[u:] != codes[:-u]) if len(codes) > u else np.empty(0, int)
                       for u in range(1, 5)]
        ascii_ = np.minimum(codes, 127)
        step = codes[1:] - codes[:-1]
        known = _ALNUM[ascii_] & (codes < 127)
        alphabet = np.where((np.abs(step) == 1) & known[1:] & known[:-1], step, 0)
        row, col = _KEY_ROW[ascii_], _KEY_COLUMN[ascii_]
        down, right = row[1:] - row[:-1], col[1:] - col[:-1]       # columns in half keys
        near = (np.abs(down) <= 1) & (np.abs(right) <= 2) & (step != 0) & (row[1:] >= 0) & (row[:-1] >= 0)
        self.walks = ((_Steps(np.where(near, 10 * (down + 2) + right + 3, 0)), math.log10(47)),
                      (_Steps(alphabet), 1.4))

    def starting(self, at: int):
        """(end, cost) of the segments that start at ``at``."""
        value, low, plain, n = self.value, self.low, self.plain, len(self.value)
        for end in range(at + 3, min(n, at + self.longest) + 1):
            rank = self.ranks.get(plain[at:end])
            if rank:
                yield end, math.log10(rank + 1) + 0.5 * (value[at:end] != plain[at:end])
        for pattern, cost in ((_DATE, 4.7), (_YEAR, 2.2)):
            m = pattern.match(value, at)
            if m:
                yield m.end(), cost
        for unit in range(1, 5):                    # a unit of 1-4 characters, repeated
            if at + 2 * unit <= n:
                differ = self.differ[unit - 1]
                k = np.searchsorted(differ, at)
                equal = (int(differ[k]) if k < len(differ) else n - unit) - at
                length = unit * (1 + equal // unit)
                if length >= max(3, 2 * unit):
                    yield at + length, sum(map(_char_cost, value[at:at + unit])) + math.log10(length / unit)
        for steps, first in self.walks:
            if at + 3 <= n:
                end, turns = steps.walk(at)
                if end - at >= 3:
                    yield end, first + math.log10(end - at) + turns * 0.7


def _segments(value: str, lexicon: str | None = None):
    """(start, end, cost) of every cheap segment of a value."""
    found = _Value(value, lexicon)
    for at in range(len(value)):
        for end, cost in found.starting(at):
            yield at, end, cost


def guess_cost(value: str, enough: float = math.inf, lexicon: str | None = None) -> float:
    """log10 of the guesses the cheapest segmentation of ``value`` needs, or
    ``enough`` if that is not less.

    The table is filled forwards, and only for places that some segmentation
    reaches for less than ``enough``: a long value costs its repeats and walks,
    found once, and a few places, not a pass over all its characters."""
    n = len(value)
    found = _Value(value, lexicon)
    # whole[k]: cheapest cover of value[:k]; brute[k]: the same, ending in a brute-force span
    whole, brute, places = {0: 0.0}, {}, [0]
    seen = -1
    while places:
        at = heapq.heappop(places)
        if at == seen:
            continue
        seen = at
        best = min(whole.pop(at, math.inf), open_ := brute.pop(at, math.inf))
        if at == n:
            return best
        joint = best + (_SEGMENT if at else 0)
        cost = min(open_, joint) + _char_cost(value[at])
        if cost < enough:
            brute[at + 1] = cost
            heapq.heappush(places, at + 1)
        for end, cost in found.starting(at):
            if joint + cost < min(enough, whole.get(end, math.inf)):
                whole[end] = joint + cost
                heapq.heappush(places, end)
    return enough


def find_spans(text: str | None, min_cost: float = MIN_COST) -> list[tuple[int, int, int, int]]:
    """(start, kind index, end, start of the secret itself) by start, then kind."""
    if not text:
        return []
    low = text.lower()
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        base = [(s, e) for s, _, e, _ in found]
        for m in _CONTEXT.finditer(text):
            at, end = m.span(m.lastindex)
            while end > at and text[end - 1] in ".!?:":
                end -= 1
            if end - at >= 6 and not any(s < end and at < e for s, e in base) \
                    and guess_cost(text[at:end], min_cost) >= min_cost:
                found.append((at, 3, end, at))
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         min_cost: float = MIN_COST) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans of every row."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find_spans(t, min_cost) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in range(4)]
        base = [hashlib.sha256(_joined(s for s in r if s[1] < 3).encode()).hexdigest() for r in rows]
        return pa.record_batch([batch.column(0), *counts[:3], pa.array(base, pa.string()),
                                pa.array([_joined(r) for r in rows], pa.string()), counts[3]],
                               names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                                      "spans", "n_guess"])
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(text_col).cast("string").alias("text")), fn,
                       "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                       "spans string, n_guess long")


def mask(text: str | None, min_cost: float = MIN_COST, with_text: str = MASK) -> str | None:
    """``text`` with every secret replaced; names before a value stay."""
    spans = find_spans(text, min_cost)
    if not spans:
        return text
    out, at = [], 0
    for begin, end in sorted((s[3], s[2]) for s in spans):
        if begin >= at:
            out += [text[at:begin], with_text]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """``docs`` (all rows and columns) with the secrets in the text masked."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return replace_column(batch, text_col, pa.array([mask(t, min_cost) for t in texts], pa.string()))
    return map_batches(docs, fn, docs.schema)


QUERY_NAME = "op5_secret_scan"
#: The guess cost is a dynamic program per value; tested against brute force.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    return scan(open_table(spark, sf_dir, "documents").select("doc_id", "text"))

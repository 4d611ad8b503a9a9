"""Best-fit packing of token sequences.

Documents are tokenised, cut into pieces of at most ``CAPACITY`` tokens, and
the pieces are packed into as few sequences as possible:

1. *Length histogram*: a grouped count, at most CAPACITY rows whatever the
   input, is all the solver sees.
2. *Configuration linear program*: a sequence is a multiset of lengths
   (a configuration).  Multiplicative weights give every length a price; the
   pricing problem, the most valuable configuration, is a knapsack solved by
   dynamic programming over the capacity.  Lengths that the configurations
   chosen so far cover too little grow dearer, the others cheaper.
3. *Rounding*: the fractional plan is rounded down.  What is left is placed by
   further knapsack rounds among the lengths still there and a best-fit pass
   into the narrowest gaps, or by that pass alone, whichever needs fewer.
4. *Placement*: each piece gets its rank among the pieces of its length (rank
   in a hash block + counts of the blocks before), and the plan, a sorted list
   of rank ranges, turns rank into sequence and offset.

The plan has at most a few entries per length and round, not per document, so
its broadcast is bounded by CAPACITY.  Pieces of full capacity fill a sequence
by themselves and skip all this.

Token ids are those of the ``tokenizers`` file.  Texts inside Latin-1 take a
faster route through ``tiktoken``: the same byte-pair merges, with a blank as
the word-end mark; everything else goes through ``tokenizers`` itself.

Defined cases: null or empty text is the end token alone; repeated rows are
packed like any others; a null doc_id is carried along; no rows give no
sequences; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_batches, materialise, open_table

CAPACITY = 4096
END_TOKEN = 1
#: Rounds of the linear program, and at most so many of rounding.
LP_ROUNDS, ROUNDING_ROUNDS = 40, 60
LEARNING = 0.35
#: Byte sequences that a worker remembers the ids of.
CACHE_PIECES = 150_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of texts under one word-end BPE file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = Tokenizer.from_file(path)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            ended = token.endswith("</w>")
            core = token[:-4] if ended else token
            ranks[bytes(byte_of[c] for c in core) + (b" " if ended else b"")] = number
        fast = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.piece = fast._core_bpe.encode_single_piece
        low = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
        self.low = low
        letters = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
        numbers = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
        blank = rb"\t\n\x0b\x0c\r \x85\xa0"
        self.words = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[" + letters + rb"]+|[" + numbers + rb"]|[^"
                                + letters + numbers + blank + rb"]+")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, word: bytes) -> bytes:
        ids = np.array(self.piece(word.decode("latin-1").encode() + b" "), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                words = self.words.findall(text.encode("latin-1").translate(self.low))
            except UnicodeEncodeError:
                words = None
            if words is not None:
                known, ids = self.known.get, self._ids
                return b"".join([known(w) or ids(w) for w in words])
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds its token ids."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_TOKEN], "<u4").tobytes()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoder(path).encode
        rows, number, start, length, crc, ids = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            raw = (encode(text) if text else b"") + end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at:at + 4 * capacity]
                rows.append(row)
                number.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
               pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(out, names=names)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(text_col).cast("string").alias("text")), fn,
                       PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- solver

def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, last item) of the best configuration for every capacity; items may
    repeat.  Item -1 leaves one token of the capacity unused."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        n = fits[c]
        if n:
            total = price[:n] + value[c - lengths[:n]]
            k = int(total.argmax())
            if total[k] > value[c]:
                value[c], last[c] = total[k], k
    return value, last


def _configurations(lengths, last, first, capacity) -> tuple[np.ndarray, np.ndarray]:
    """Best configuration containing each item of ``first``: all items in a row,
    and how many belong to each configuration."""
    filled = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
    items, sizes = [], []
    for lo in range(0, len(first), 1024):
        steps = [first[lo:lo + 1024]]
        room = filled[capacity - lengths[steps[0]]]
        while room.any():
            item = np.where(room > 0, last[room], -1)
            room = filled[np.where(item >= 0, room - lengths[item], 0)]
            steps.append(item)
        rows = np.stack(steps, axis=1)
        items.append(rows[rows >= 0])
        sizes.append((rows >= 0).sum(axis=1))
    return np.concatenate(items), np.concatenate(sizes)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(configuration of lengths, number of sequences) covering every item once.

    ``lengths`` are distinct, ascending and at most ``capacity``."""
    lengths, left = np.asarray(lengths, np.int64), np.array(counts, np.int64)
    plan: dict[tuple[int, ...], int] = {}
    if not len(lengths):
        return []
    fractional, price = _linear_program(lengths, left.astype(float), capacity)
    for config, share in sorted(fractional.items(), key=lambda p: (-p[1], p[0])):
        _take(plan, left, lengths, config, int(share))
    # the rest is rounded in two ways; the one with fewer sequences stays
    fitted, rest = dict(plan), left.copy()
    waste = 0
    for _ in range(ROUNDING_ROUNDS):
        items = np.flatnonzero(left)
        if not len(items) or waste > capacity // 64:
            break
        if not _rounding_round(plan, left, lengths, price, items, capacity, capacity - waste):
            waste = max(1, 2 * waste)
    _best_fit(plan, left, lengths, capacity)
    _best_fit(fitted, rest, lengths, capacity)
    return sorted(min(plan, fitted, key=lambda p: sum(p.values())).items(), reverse=True)


def _take(plan, left, lengths, config, times) -> int:
    """Use a configuration (item numbers) as often as asked and available."""
    need: dict[int, int] = {}
    for k in config:
        need[k] = need.get(k, 0) + 1
    times = min([times, *(int(left[k]) // n for k, n in need.items())])
    if times > 0:
        for k, n in need.items():
            left[k] -= n * times
        key = tuple(sorted((int(lengths[k]) for k in config), reverse=True))
        plan[key] = plan.get(key, 0) + times
    return times


def _linear_program(lengths, demand, capacity):
    """Fractional use of configurations, and the last prices."""
    covered = np.zeros(len(lengths))
    plan: dict[tuple[int, ...], float] = {}
    weight = np.ones(len(lengths))
    base = lengths / capacity
    everything = np.arange(len(lengths))
    for t in range(1, LP_ROUNDS + 1):
        price = base * weight
        value, last = _knapsack(lengths, price, capacity)
        # the best configuration of each length; those of nearly the best value carry this round
        worth = price + value[capacity - lengths]
        good = everything[worth >= 0.995 * value[capacity]]
        items, sizes = _configurations(lengths, last, good, capacity)
        ends = np.cumsum(sizes)
        short = np.maximum(demand[good] * t / LP_ROUNDS - covered[good], 0)
        use = np.zeros(len(lengths))
        np.add.at(use, items, np.repeat(short, sizes))
        over = use > 0
        # no length may be used beyond what all rounds so far should have covered
        limit = np.ones(len(lengths))
        limit[over] = np.minimum(1, np.maximum(demand[over] * t / LP_ROUNDS - covered[over], 0) / use[over])
        amount = short * np.minimum.reduceat(limit[items], ends - sizes)
        np.add.at(covered, items, np.repeat(amount, sizes))
        for end, n, x in zip(ends, sizes, amount):
            if x > 0:
                config = tuple(np.sort(items[end - n:end]).tolist())
                plan[config] = plan.get(config, 0.0) + float(x)
        lag = 1 - covered / (demand * t / LP_ROUNDS)
        weight = np.exp(LEARNING * np.clip(lag, -1, 1)) * weight
        weight /= weight.mean()
        weight = np.clip(weight, 0.5, 2.0)
    return plan, base * weight


def _rounding_round(plan, left, lengths, price, items, capacity, least) -> int:
    """One knapsack over the lengths that are left; largest lengths first, each
    with its best configuration (of at least ``least`` tokens) while items last."""
    now = lengths[items]
    fill = now / capacity + 1e-6 * price[items]
    _, last = _knapsack(now, fill, capacity)
    members, sizes = _configurations(now, last, np.arange(len(items)), capacity)
    ends = np.cumsum(sizes)
    size = np.add.reduceat(now[members], ends - sizes)
    placed = 0
    for r in np.argsort(-now, kind="stable"):
        if size[r] < least:
            continue
        config = items[members[ends[r] - sizes[r]:ends[r]]].tolist()
        # a share only, so that other lengths meet their own best partners too
        want = max(1, int(left[config[0]] + 1) // 2)
        placed += _take(plan, left, lengths, config, want)
    return placed


def _best_fit(plan, left, lengths, capacity) -> None:
    """Best fit decreasing of what is left, in groups of equal sequences; gaps of
    sequences already planned are open as well."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for config, n in plan.items():
        room = capacity - sum(config)
        if room:
            rooms.setdefault(room, {})[config] = n
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        left[k] = 0
        while n:
            room = min((r for r in rooms if r >= size and rooms[r]), default=None)
            if room is None:
                each = capacity // size
                whole, rest = divmod(n, each)
                for times, m in ((whole, each), (1, rest)):
                    if times and m:
                        _open(plan, rooms, (size,) * m, times, capacity)
                n = 0
                continue
            config = next(iter(rooms[room]))
            m = min(n, rooms[room][config])
            rooms[room][config] -= m
            if not rooms[room][config]:
                del rooms[room][config]
            plan[config] -= m
            if not plan[config]:
                del plan[config]
            _open(plan, rooms, tuple(sorted((*config, size), reverse=True)), m, capacity)
            n -= m


def _open(plan, rooms, config, times, capacity) -> None:
    plan[config] = plan.get(config, 0) + times
    room = capacity - sum(config)
    if room:
        own = rooms.setdefault(room, {})
        own[config] = own.get(config, 0) + times


# ------------------------------------------------------------- placement

def _slots(plan) -> dict[str, np.ndarray]:
    """Rank ranges per length: from rank ``start`` on (ranks counted over all
    lengths in ascending order), sequence = first + rank - start."""
    length, count, first, offset = [], [], [], []
    base = 0
    for config, times in plan:
        at = 0
        for size in config:
            length.append(size)
            count.append(times)
            first.append(base)
            offset.append(at)
            at += size
        base += times
    order = np.argsort(np.array(length, np.int64), kind="stable")
    length, count, first, offset = (np.array(v, np.int64)[order] for v in (length, count, first, offset))
    return {"length": length, "start": np.concatenate(([0], np.cumsum(count)))[:-1].astype(np.int64),
            "first": first, "offset": offset}


def pack(rows: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"),
         block_rows: int = 20_000) -> DataFrame:
    """``rows`` (a written table with a ``length`` column) plus sequence_id and offset."""
    short = rows.where(F.col("length") < capacity)
    histogram = short.groupBy("length").count().toArrow()
    sizes, counts = (histogram.column(c).to_numpy() for c in ("length", "count"))
    order = np.argsort(sizes)
    slots = _slots(solve(sizes[order], counts[order], capacity))
    first_rank = {int(s): int(r) for s, r in zip(*np.unique(slots["length"], return_index=True))}
    base = {s: int(slots["start"][k]) for s, k in first_rank.items()}
    shared = rows.sparkSession.sparkContext.broadcast((slots, base))
    total = int(counts.sum()) if len(counts) else 0

    spread = F.pmod(F.xxhash64(*order_by), F.lit(max(8, -(-total // block_rows))))
    dealt = short.withColumn("_block", spread)
    within = dealt.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_block").orderBy(*order_by)) - 1)
    before = (dealt.groupBy("length", "_block").count()
              .withColumn("_before", F.sum("count").over(
                  Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before")))
    ranked = within.join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, starts = shared.value
        size = batch.column(batch.schema.get_field_index("length")).to_numpy()
        at = batch.column(batch.schema.get_field_index("_rank")).to_numpy() \
            + np.array([starts[int(s)] for s in size], np.int64)
        k = np.searchsorted(table["start"], at, "right") - 1
        batch = batch.append_column("sequence_id", pa.array(table["first"][k] + at - table["start"][k]))
        return batch.append_column("offset", pa.array(table["offset"][k])).drop_columns(["_rank"])
    ranked = ranked.select(*rows.columns, F.col("_rank").cast("long").alias("_rank"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = map_batches(ranked, place, names + ", sequence_id long, offset long")
    # a full piece is a sequence: negative numbers, from its position in the table
    full = rows.where(F.col("length") >= capacity) \
        .withColumn("sequence_id", -1 - F.monotonically_increasing_id()) \
        .withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from packed pieces
    that carry ``ids``; a sequence has at most CAPACITY tokens."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))),
                              lambda s: s["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids)."""
    return pack(materialise(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


QUERY_NAME = "op1_best_fit_packing"
#: Needs a tokenizer and a solver; tested for validity, exact ids and sequence count.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack_documents(open_table(spark, sf_dir, "documents").select("doc_id", "text"))

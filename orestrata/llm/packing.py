"""Best-fit packing of documents into token sequences by exact complements.

Pieces of equal length are interchangeable, so the packing is planned on the
histogram of piece lengths, which has at most ``capacity`` rows whatever the
size of the corpus. The sums of single lengths, pairs and triples are indexed by
hash; the plan is a list of patterns with multiplicities: a length with the
single, pair or triple that fills its sequence exactly, as many times as all
parts are available, then best-fit for what is left. Pieces get a rank within
their length (by chunks of row numbers, so neither a common length nor a row that
repeats is one task), and a rank is a place in the plan.

Defined cases: a null or empty text is the closing id alone; a text longer than
the capacity is cut into full pieces and a remainder; repeated rows and repeated
ids are packed as separate documents; an empty table gives no rows; columns other
than the two that are read are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, small_batches, table

TOKENIZER = "word_bpe_49k.json"


class WordIds(dict):
    """Bytes of the ids (little-endian, 32 bits) of a word without ASCII white space.

    White space never enters a token of this tokenizer, so the ids of a text are
    those of its words. Words of letters go to the merge model at once; the others
    take the whole way. Entries are dropped when there are ``limit`` of them.
    """

    _PUNCTUATED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.alphabet = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids = self._ids(word)
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            if not text.isascii():
                text = word.decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        m = self._PUNCTUATED.fullmatch(word)
        if m and m[1].decode("utf-8", "replace").isalpha():
            return self[m[1]] + self[m[2]]
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if b"<|" in raw:  # special tokens are told apart by case
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, raw.lower().split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(name: str = TOKENIZER) -> WordIds:
    """One per Python worker. ``name`` is a file, or a name that public_tokenizers knows."""
    if name not in _LOADED:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LOADED[name] = WordIds(str(path))
    return _LOADED[name]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()
    key = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", key), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(tokenizer)
        for b in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, x in enumerate(b.column(1)):
                ids = enc.of_text(x.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())] + [pa.array(v, pa.int64()) for v in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Pattern:
    """``times`` sequences that each hold the lengths of ``items`` (length, repeats)."""

    items: list[tuple[int, int]]
    times: int


class SumIndex:
    """Sums of one, two and three available lengths, hashed by the sum.

    Availability only falls, so an entry that is used up never comes back: the entries of a sum are listed when it
    is first asked for, and a cursor goes past the dead ones. Lists hold at most ``capacity`` / 2 pairs a sum, and
    a triple is a largest length with the sum of the other two.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.pairs: dict[int, list] = {}
        self.triples: dict[int, list] = {}

    def times(self, lengths: list[int]) -> int:
        """How often these lengths, with their repeats, are available together."""
        return min(int(self.left[n]) // lengths.count(n) for n in lengths)

    def single(self, total: int, beside: list[int]) -> list[int] | None:
        return [total] if total > 0 and self.times([*beside, total]) else None

    def pair(self, total: int, beside: list[int]) -> list[int] | None:
        if total not in self.pairs:
            a = np.arange((total + 1) // 2, max(0, total - 1) + 1)
            a = a[(self.left[a] > 0) & (self.left[total - a] > 0)]
            # The most plentiful first, so that few patterns take many pieces.
            a = a[np.argsort(-np.minimum(self.left[a], self.left[total - a]), kind="stable")]
            self.pairs[total] = [0, [(int(x), total - int(x)) for x in a]]
        return self._next(self.pairs[total], lambda e: list(e), lambda e: self.times(list(e)) > 0, beside)

    def triple(self, total: int, beside: list[int]) -> list[int] | None:
        if total not in self.triples:
            a = np.flatnonzero(self.left[: max(0, total - 1)])[::-1]
            self.triples[total] = [0, [int(x) for x in a if 3 * x >= total]]

        def whole(a: int) -> list[int] | None:
            rest = self.pair(total - a, [*beside, a])
            return [a, *rest] if rest else None

        return self._next(self.triples[total], whole, lambda a: self.left[a] > 0 and self.pair(total - a, []) is not None, beside)

    def _next(self, entry: list, parts, alive, beside: list[int]) -> list[int] | None:
        """The first entry that is available beside other lengths; the cursor goes past leading dead entries."""
        cursor, items = entry
        for i in range(cursor, len(items)):
            found = parts(items[i])
            if found and self.times([*beside, *found]):
                return found
            if i == entry[0] and not alive(items[i]):
                entry[0] = i + 1
        return None


def plan_patterns(counts: dict[int, int], capacity: int = 4096) -> list[Pattern]:
    """Patterns that use every length exactly as often as ``counts`` has it.

    From the longest length down, a gap is filled exactly by the single, else the
    pair, else the triple of available lengths that the index has for it, as many
    times as all parts are available; what no combination completes goes to best-fit.
    """
    index = SumIndex(counts, capacity)
    out: list[Pattern] = []
    for n in sorted(counts, reverse=True):
        while index.left[n]:
            if n == capacity:
                parts: list[int] | None = []
            else:
                parts = index.single(capacity - n, [n]) or index.pair(capacity - n, [n]) or index.triple(capacity - n, [n])
            if parts is None:
                break
            lengths = [n, *parts]
            times = index.times(lengths)
            for x in lengths:
                index.left[x] -= times
            out.append(Pattern(sorted({x: lengths.count(x) for x in lengths}.items(), reverse=True), times))
    return out + _best_fit(index.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over classes of equal lengths and equal gaps."""
    gaps: dict[int, list[Pattern]] = {}
    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                gap, bins = capacity, Pattern([], c)  # as many new ones as could be needed
            else:
                bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            per = gap // n
            full, part = min(bins.times, c // per), 0
            if full < bins.times:
                part = c - full * per if c - full * per < per else 0
            for times, k in ((full, per), (1 if part else 0, part)):
                if times:
                    gaps.setdefault(gap - k * n, []).append(Pattern([*bins.items, (n, k)], times))
            spare = bins.times - full - (1 if part else 0)
            if spare and bins.items:
                gaps.setdefault(gap, []).append(Pattern(bins.items, spare))
            c -= full * per + part
    return [p for ps in gaps.values() for p in ps]


def plan_table(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of ranks: pieces of ``length`` with ranks from ``lo`` on go to sequence
    ``seq + (rank - lo) // repeats`` at ``offset + (rank - lo) % repeats * length``."""
    seen: dict[int, int] = {}
    rows = []
    seq = 0
    for p in patterns:
        offset = 0
        for n, k in p.items:
            lo = seen.get(n, 0)
            rows.append((n, lo, seq, k, offset))
            seen[n] = lo + k * p.times
            offset += n * k
        seq += p.times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "seq", "repeats", "offset"), cols, strict=True))


_RANK_BITS = 48


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 4096, end_id: int = 1, chunk_rows: int = 1000) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    To the driver come at most ``capacity`` rows (the histogram); the plan that is
    broadcast has a bounded number of runs too, as each of its steps uses up a
    length or a gap.
    """
    # A number for each row, kept with it: equal rows are told apart by it.
    cut_pieces = cut(pieces(docs, tokenizer, capacity, end_id).withColumn("_p_row", F.monotonically_increasing_id()))
    histogram = cut_pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    plan = plan_table(plan_patterns(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    # Chunks of a length: as many as its count asks for.
    most = F.create_map(*[F.lit(v) for n, c in sorted(counts.items()) if c > chunk_rows for v in (n, -(-c // chunk_rows))]) if any(c > chunk_rows for c in counts.values()) else None
    chunks = F.lit(1) if most is None else F.coalesce(F.element_at(most, F.col("length")), F.lit(1))
    keyed = cut_pieces.withColumn("_p_chunk", F.pmod(F.xxhash64("_p_row"), chunks).cast("int"))
    sizes = keyed.groupBy("length", "_p_chunk").agg(F.count("*").alias("_p_n"))
    before = Window.partitionBy("length").orderBy("_p_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_p_before", F.coalesce(F.sum("_p_n").over(before), F.lit(0))).drop("_p_n")
    within = Window.partitionBy("length", "_p_chunk").orderBy("_p_row")
    ranked = (
        keyed.withColumn("_p_rank", F.row_number().over(within) - 1)
        .join(sizes, ["length", "_p_chunk"])
        .withColumn("_p_rank", F.col("_p_rank") + F.col("_p_before"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p_rank").cast("long").alias("_p_rank"))
    )
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        starts = (p["length"] << _RANK_BITS) + p["lo"]
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(starts, (n << _RANK_BITS) + rank, side="right") - 1
            d = rank - p["lo"][at]
            k = p["repeats"][at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(p["seq"][at] + d // k), pa.array(p["offset"][at] + d % k * n)],
                names=[f.name for f in schema.fields],
            )

    return ranked.mapInArrow(place, schema)


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

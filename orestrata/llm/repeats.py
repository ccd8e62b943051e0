"""Suffix-array dedup: every byte that a repeated string of ``width`` bytes covers goes, but for the string's first place.

A corpus's suffixes don't fit in one sort, so windows (strings of ``width`` bytes)
that can be equal are brought together first. Each window names the gram of least
hash within it; neighbours mostly name the same one. A stretch of windows that
name one gram is a snippet, and equal windows lie in snippets of one gram. Only
the snippets of grams that occur more than once go on. Equal snippets are counted
once, with their first place, already in the task that reads the texts: the others
repeat it wholly. The distinct snippets of a gram then meet in a shard, whose
suffixes are sorted in two stages (:mod:`orestrata.llm.suffixes`); windows with a
common prefix of ``width`` bytes are neighbours in that order, and all but the
first of them are repeats.

A gram with very many different snippets is dealt into several shards. What is
first in such a shard is looked up once more across shards, by a hash of the
window, so no shard grows with the corpus. Hashes of snippets and windows have 128 bits.

Places are ordered by document (null ids last; among equal ids by a hash of the
text), then by byte. Defined cases: a null text is empty; texts shorter than
``width`` bytes stay whole; of rows that repeat id and text, one is the first and
the others go wholly; matches never cross documents; what is left needn't be valid
UTF-8, so it is given as bytes; an empty table gives no rows; columns other than
the two are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, small_batches, stored, table
from orestrata.llm.suffixes import common_prefixes, suffix_array, words_at

WIDTH, GRAM = 100, 32
#: Bytes hashed at a time, so that one very long text needs bounded memory; places in a block need 20 bits.
_BLOCK, _PLACE = 1 << 19, np.uint64((1 << 20) - 1)
#: Different snippets of a gram in one shard, and bytes of snippets that are sorted at once.
SHARD_SNIPPETS, SHARD_BYTES = 4096, 1 << 20
_rng = np.random.default_rng(42)
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

DUPLICATE, WANTED, SPLIT = 0, 1, 2


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[14]
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the ``gram`` bytes (a power of two) at each place."""
    h, n, k = _BYTE[data], 1, 0
    while n < gram:
        h = h[:-n] * _MIX[k] + h[n:]
        n, k = 2 * n, k + 1
    return _scrambled(h)


def least_of(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    n = 1
    while 2 * n <= size:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[: len(keys) - (size - n)], keys[size - n :]) if size > n else keys


def snippets(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """``document, start, windows, gram hash, snippet hash`` of all stretches of windows that name one gram.

    ``data`` has the documents' bytes one after the other, up to ``ends``.
    """
    found = []
    for at in range(0, max(0, len(data) - width + 1), _BLOCK):
        block = data[at : at + _BLOCK + width - 1]
        h = gram_hashes(block, gram)
        keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        named = (least_of(keys, width - gram + 1) & _PLACE).astype(np.int64)
        valid = np.ones(len(named), dtype=bool)
        for e in ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(block) + width)] - at:
            valid[max(0, e - width + 1) : max(0, e)] = False
        new = np.ones(len(named) + 1, dtype=bool)
        new[1:-1] = (named[1:] != named[:-1]) | (valid[1:] != valid[:-1])
        edges = np.flatnonzero(new)
        first, after = edges[:-1], edges[1:]
        here = valid[first]
        first, after = first[here], after[here]
        last = after - 1 + width - gram  # the last gram of the snippet
        s = (after - first).astype(np.uint64) * _MIX[13]
        for k, d in enumerate(range(0, 2 * width, gram)):
            s = (s ^ (s >> np.uint64(32))) * _MIX[k] + h[np.minimum(first + d, last)]
        found.append((first + at, after - first, h[named[first]], _scrambled(s)))
    if not found:
        return [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0, dtype=np.uint64)] * 2
    start, windows, g, s = (np.concatenate(x) for x in zip(*found))
    document = np.searchsorted(ends, start, side="right")
    begins = np.concatenate([[0], ends[:-1]])
    return document, start - begins[document], windows, g, s


def _differs(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """For each row whether it differs from the one before; nulls are alike."""
    if before is not None:
        column = pa.concat_arrays([pa.array([before.as_py()], column.type), column])
    x, y = column[1:], column[:-1]
    out = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(x.is_null(), y.is_null())).to_numpy(zero_copy_only=False)
    return out if before is not None else np.concatenate([[True], out])


def _intervals(row: np.ndarray, start: np.ndarray, windows: np.ndarray):
    """Those of one row that touch, as one; sorted by row and start before."""
    if not len(row):
        return row, start, windows
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.add.reduceat(windows, at)


def _gathered(docs: DataFrame, width: int) -> DataFrame:
    """A row for each distinct snippet that a batch of texts has, with its first place there, and rows of what repeats within the batch.

    ``kind, a`` (gram; for repeats the text's hash), ``s`` (snippet), ``doc_id, doc, p, n`` and ``many`` (whether the batch has it more than once).
    """
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("doc_id", key), T.StructField("doc", T.LongType()), T.StructField("p", T.LongType()), T.StructField("n", T.LongType()), T.StructField("many", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, doc = b.column(0), b.column(1)
            texts = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            row, p, n, g, s = snippets(data, offsets[1:] - offsets[0], width)
            order = pc.sort_indices(pa.table({"i": ids, "d": doc}), sort_keys=[("i", "ascending"), ("d", "ascending")], null_placement="at_end").to_numpy()
            sorted_ids, sorted_doc = ids.take(pa.array(order)), doc.take(pa.array(order))
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.cumsum(_differs(sorted_ids, None) | _differs(sorted_doc, None))
            order = np.lexsort((p, rank[row], s, g))
            row, p, n, g, s = (x[order] for x in (row, p, n, g, s))
            r = rank[row]
            same = np.zeros(len(row), dtype=bool)
            same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            again = same.copy()  # the same place of rows that repeat id and text
            again[1:] &= (r[1:] == r[:-1]) & (p[1:] == p[:-1])
            first = np.flatnonzero(~same)
            count = np.add.reduceat(~again, first) if len(first) else first
            dup = np.flatnonzero(same & ~again)
            # A place that repeats the class's first row isn't a repeat of it: those stand right after it and are told by `again`.
            o = np.lexsort((p[dup], row[dup]))
            drow, dp, dn = _intervals(row[dup][o], p[dup][o], n[dup][o])
            rows = np.concatenate([row[first], drow])
            at = pa.array(rows)
            here = doc.take(at)
            k, d = len(first), len(drow)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([WANTED, DUPLICATE], dtype=np.int8), [k, d])),
                    pa.array(np.concatenate([g[first].view(np.int64), here.to_numpy()[k:]])),
                    pa.array(np.concatenate([s[first].view(np.int64), np.zeros(d, dtype=np.int64)])),
                    ids.take(at),
                    here,
                    pa.array(np.concatenate([p[first], dp])),
                    pa.array(np.concatenate([n[first], dn])),
                    pa.array(np.concatenate([count > 1, np.zeros(d, dtype=bool)])),
                ],
                names=[f.name for f in schema],
            )

    return docs.mapInArrow(run, schema)


def _repeated(rows: DataFrame, shard_snippets: int) -> DataFrame:
    """Of the rows of :func:`_gathered`: those whose snippet stood at an earlier place, as repeats, and the first of each snippet whose gram
    occurs more than once, as wanted, with the shard of its gram. Grams with more than one shard are marked."""
    key = rows.schema["doc_id"].dataType
    fields = [("kind", T.ByteType()), ("a", T.LongType()), ("shard", T.LongType()), ("doc_id", key), ("doc", T.LongType()), ("p", T.LongType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField(c, k) for c, k in fields])
    order = ["kind", "a", "s", F.col("doc_id").asc_nulls_last(), "doc", "p"]
    met = rows.repartition("a").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pending = None, None  # the last row, and a row that is wanted if its gram comes again
        instance = snippet = 0  # of the last row: places of its snippet before it, snippets of its gram before it
        repeated = False  # whether the last row's gram is known to occur more than once
        for b in batches:
            n = len(b)
            if not n:
                continue
            kind = b.column("kind").to_numpy()
            prior = (lambda c: before[c] if before else None)  # noqa: E731, B023
            new_a = _differs(b.column("a"), prior("a")) | _differs(b.column("kind"), prior("kind"))
            new_s = new_a | _differs(b.column("s"), prior("s"))
            new_i = new_s | _differs(b.column("doc_id"), prior("doc_id")) | _differs(b.column("doc"), prior("doc")) | _differs(b.column("p"), prior("p"))
            if before is None:
                new_a[0] = new_s[0] = new_i[0] = True

            def counted(step: np.ndarray, start: np.ndarray, carried: int) -> np.ndarray:
                """How many steps there were since the last start, which counts as none."""
                c = np.cumsum(step)
                base = np.where(start, c, 0)
                began = np.maximum.accumulate(base)
                return np.where(np.logical_or.accumulate(start), c - began, c + carried)

            ordinal = counted(new_i, new_s, instance)
            number = counted(new_s, new_a, snippet)
            group = np.cumsum(new_a)  # 0: the gram that the batch before ended with
            many = b.column("many").to_numpy(zero_copy_only=False)
            comes_again = np.zeros(group[-1] + 1, dtype=bool)
            np.logical_or.at(comes_again, group, many | (new_i & ~new_a))
            comes_again[0] |= repeated
            own = kind == WANTED
            wanted = own & new_s & comes_again[group]
            split = own & new_s & (number == shard_snippets)
            dup = ~own | (ordinal > 0)
            if pending is not None and (comes_again[0] or group[-1] > 0):
                if comes_again[0]:
                    yield pending
                pending = None
            take = np.concatenate([np.flatnonzero(x) for x in (dup, wanted, split)])
            shard = number[take] // shard_snippets
            kinds = np.repeat(np.array([DUPLICATE, WANTED, SPLIT], dtype=np.int8), [dup.sum(), wanted.sum(), split.sum()])
            shard[kinds == SPLIT] = 0
            yield _rows(b, take, kinds, shard)
            last = group == group[-1]
            if own[-1] and not comes_again[-1] and group[-1] > 0:
                at = np.flatnonzero(last & new_s)[:1]
                pending = _rows(b, at, np.array([WANTED], dtype=np.int8), np.zeros(1, dtype=np.int64))
            repeated = bool(comes_again[-1])
            instance, snippet = int(ordinal[-1]), int(number[-1])
            before = {c: b.column(c)[n - 1] for c in ("kind", "a", "s", "doc_id", "doc", "p")}

    def _rows(b: pa.RecordBatch, take: np.ndarray, kinds: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        at = pa.array(take)
        return pa.RecordBatch.from_arrays([pa.array(kinds), b.column("a").take(at), pa.array(shard), *[b.column(c).take(at) for c in ("doc_id", "doc", "p", "n")]], names=[c for c, _ in fields])

    return met.mapInArrow(run, schema)


def _texts(docs: DataFrame, rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The texts of ``docs`` that ``rows`` speak of. Up to ``most`` hashes (8 bytes each) go to the texts as a broadcast, so that no others are moved;
    with more, all texts of a window's length are."""
    keys = cut(rows.select("doc").distinct())
    if keys.count() <= most:
        return docs.join(F.broadcast(keys), "doc", "left_semi").select("doc_id", "doc", "text")
    return docs


def _with_texts(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` and after them their document's text, document by document."""
    texts = docs.select("doc_id", "doc", *[F.lit(None).cast("long").alias(c) for c in columns], F.lit(1).alias("last"), "text")
    met = rows.select("doc_id", "doc", *columns, F.lit(0).alias("last"), F.lit(None).cast("binary").alias("text")).unionByName(texts)
    return met.repartition("doc", "doc_id").sortWithinPartitions("doc", "doc_id", "last", columns[0])


def _cut_out(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of each wanted snippet."""
    met = _with_texts(_texts(docs, wanted), wanted, ["p", "n", "a", "shard"])
    schema = T.StructType([*[met.schema[c] for c in ("doc_id", "doc", "p", "n", "a", "shard")], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the document whose text is still to come; as many as its text has snippets
        for b in batches:
            ends = np.flatnonzero(b.column("last").to_numpy())
            done = 0
            for e in ends:
                part = b.slice(done, e - done)
                done = e + 1
                rows = pa.Table.from_batches([*held, part]).combine_chunks() if held else pa.Table.from_batches([part])
                held = []
                if rows.num_rows:
                    text = b.column("text")[int(e)].as_py()
                    p, n = rows["p"].to_pylist(), rows["n"].to_pylist()
                    rows = rows.drop_columns(["last", "text"]).append_column("bytes", pa.array([text[i : i + k + width - 1] for i, k in zip(p, n)], pa.binary()))
                    yield from rows.select(schema.names).to_batches()
            if done < len(b):
                held.append(b.slice(done))

    return met.mapInArrow(run, schema)


def _sorted_out(pieces: DataFrame, width: int) -> DataFrame:
    """Windows of the wanted snippets that stand at an earlier place in another snippet of their shard, as repeats; for grams of several
    shards also those that are first in theirs, with the hash of the window."""
    fields = [("kind", T.ByteType()), ("doc_id", pieces.schema["doc_id"].dataType), ("doc", T.LongType()), ("p", T.LongType()), ("n", T.LongType()), ("w1", T.LongType()), ("w2", T.LongType())]
    schema = T.StructType([T.StructField(c, k) for c, k in fields])
    met = pieces.repartition("a", "shard").sortWithinPartitions("a", "shard", F.col("bytes").isNotNull(), F.col("doc_id").asc_nulls_last(), "doc", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, before = 0, None
        for b in batches:
            if not len(b):
                continue
            new = _differs(b.column("a"), before and before[0]) | _differs(b.column("shard"), before and before[1])
            before = (b.column("a")[len(b) - 1], b.column("shard")[len(b) - 1])
            length = np.cumsum(pc.fill_null(pc.binary_length(b.column("bytes")), 0).to_numpy())
            done = 0
            for e in np.flatnonzero(new):  # shards go on to the sorter when there are enough bytes, whole
                if size + (length[e - 1] if e else 0) - (length[done - 1] if done else 0) >= SHARD_BYTES:
                    yield from _shard(pa.Table.from_batches([*held, b.slice(done, e - done)]), width, schema)
                    held, size, done = [], 0, e
            held.append(b.slice(done))
            size += int(length[-1] - (length[done - 1] if done else 0))
        if held:
            yield from _shard(pa.Table.from_batches(held), width, schema)

    return met.mapInArrow(run, schema)


def _shard(rows: pa.Table, width: int, schema: T.StructType) -> list[pa.RecordBatch]:
    """Sorts the suffixes of some whole shards' snippets. Rows without bytes mark grams of several shards."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return []
    columns = {c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in rows.column_names}
    columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
    a, shard = columns["a"].to_numpy(), columns["shard"].to_numpy()
    mark = columns["bytes"].is_null().to_numpy(zero_copy_only=False)
    several = (shard > 0) | np.isin(a, a[mark])
    keep = np.flatnonzero(~mark)
    if not len(keep):
        return []
    columns = {c: x.take(pa.array(keep)) for c, x in columns.items()}
    several = several[keep]
    p, n = columns["p"].to_numpy(), columns["n"].to_numpy()
    pieces = columns["bytes"].to_pylist()
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8)
    starts = np.cumsum([0, *[len(x) + 1 for x in pieces]])
    owner = np.repeat(np.arange(len(pieces)), np.diff(starts))
    inner = np.arange(len(data)) - starts[owner]
    words = words_at(data, width + 8)
    order = suffix_array(data, width, words)
    order = order[inner[order] < n[owner[order]]]
    new = common_prefixes(order, words, width) < width
    # Rows are sorted by gram and shard first, so documents are ranked anew.
    ids, doc = columns["doc_id"], columns["doc"]
    by = pc.sort_indices(pa.table({"i": ids, "d": doc}), sort_keys=[("i", "ascending"), ("d", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(len(pieces), dtype=np.int64)
    rank[by] = np.cumsum(_differs(ids.take(pa.array(by)), None) | _differs(doc.take(pa.array(by)), None))
    who, where = rank[owner[order]], p[owner[order]] + inner[order]
    run = np.cumsum(new)
    sort = np.lexsort((where, who, run))
    order, run, who, where = order[sort], run[sort], who[sort], where[sort]
    first = np.ones(len(order), dtype=bool)
    first[1:] = run[1:] != run[:-1]
    lead = np.flatnonzero(first)[run - run[0]] if len(run) else run
    same_place = (who == who[lead]) & (where == where[lead])
    repeat = np.sort(order[~same_place])
    row, start, windows = _intervals(owner[repeat], p[owner[repeat]] + inner[repeat], np.ones(len(repeat), dtype=np.int64))
    late = order[first & several[owner[order]]]
    hashes = [xxhash.xxh3_128_digest(data[i : i + width].tobytes()) for i in late]
    pair = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
    at = pa.array(np.concatenate([row, owner[late]]))
    none = np.zeros(len(row), dtype=np.int64)
    arrays = [
        pa.array(np.repeat(np.array([DUPLICATE, SPLIT], dtype=np.int8), [len(row), len(late)])),
        ids.take(at),
        doc.take(at),
        pa.array(np.concatenate([start, p[owner[late]] + inner[late]])),
        pa.array(np.concatenate([windows, np.ones(len(late), dtype=np.int64)])),
        *[pa.array(np.concatenate([none, pair[:, k]])) for k in (0, 1)],
    ]
    return [pa.RecordBatch.from_arrays(arrays, names=schema.names)]


def _later(firsts: DataFrame) -> DataFrame:
    """Of windows that are first in their shard, those that another shard has at an earlier place."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("doc").alias("d"), F.col("p").alias("p"))
    firsts = firsts.withColumn("place", place)
    least = firsts.groupBy("w1", "w2").agg(F.min("place").alias("least"), F.count("*").alias("c")).where("c > 1")
    return firsts.join(least.select("w1", "w2", "least"), ["w1", "w2"]).where(F.col("place") > F.col("least")).select("doc_id", "doc", "p", "n")


def repeats(docs: DataFrame, width: int = WIDTH, shard_snippets: int = SHARD_SNIPPETS) -> DataFrame:
    """``doc_id, doc, p, n``: the windows ``p .. p + n - 1`` of a document stand at an earlier place too. ``docs`` has ``doc_id, doc, text`` (bytes)."""
    small_batches(docs.sparkSession)
    gathered = _gathered(docs.select("doc_id", "doc", "text"), width)
    found = stored(_repeated(gathered, shard_snippets))
    wanted = found.where(F.col("kind") == WANTED)
    pieces = _cut_out(docs, wanted, width)
    marks = found.where(F.col("kind") == SPLIT).select("doc_id", "doc", "p", "n", "a", "shard", F.lit(None).cast("binary").alias("bytes"))
    sorted_out = stored(_sorted_out(pieces.unionByName(marks), width))
    known = [found.where(F.col("kind") == DUPLICATE), sorted_out.where(F.col("kind") == DUPLICATE)]
    out = known[0].select("doc_id", "doc", "p", "n").unionByName(known[1].select("doc_id", "doc", "p", "n"))
    firsts = sorted_out.where(F.col("kind") == SPLIT)
    return out if firsts.isEmpty() else out.unionByName(_later(firsts))


def without_repeats(docs: DataFrame, width: int = WIDTH, shard_snippets: int = SHARD_SNIPPETS) -> DataFrame:
    """``doc_id, n_bytes``, the ``spans`` of bytes that go (``start, end``) and the ``kept`` bytes of every document."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("doc", F.xxhash64("text"))
    found = repeats(docs.where(F.octet_length("text") >= width), width, shard_snippets)
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), *T._parse_datatype_string("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    long = docs.where(F.octet_length("text") >= width)
    met = _with_texts(long, found, ["p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: list[int] = []
        windows: list[int] = []
        before = None
        for b in batches:
            ids, out = [], []
            for i, (who, doc, p, n, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc", "p", "n", "last")))):
                if not last:
                    starts.append(p)
                    windows.append(n)
                    continue
                text = b.column("text")[i].as_py()
                again = before == (who, doc, len(text))  # a row that repeats id and text
                spans = [(0, len(text))] if again else merged(starts, windows, width)
                before, starts, windows = (who, doc, len(text)), [], []
                ids.append(i)
                out.append((len(text), [{"start": s, "end": e} for s, e in spans], without(text, spans)))
            n_bytes, spans, kept = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=schema.names)

    short = docs.where(F.octet_length("text") < width)
    none = F.array().cast("array<struct<start:long,end:long>>")
    return met.mapInArrow(run, schema).unionByName(short.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").alias("kept")))


def merged(starts: list[int], windows: list[int], width: int) -> list[tuple[int, int]]:
    """The bytes that windows cover, as maximal runs."""
    out: list[tuple[int, int]] = []
    for p, n in sorted(zip(starts, windows)):
        end = p + n + width - 1
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((p, end))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for _, e in spans]]
    begins = [*[s for s, _ in spans], len(text)]
    return b"".join(text[e:s] for e, s in zip(ends, begins))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 100 bytes as 200 hexadecimal digits, numbered among its equals; the places of those that come again are merged into spans.
OP12_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select row_number() over (order by doc_id nulls last, h) as rid, doc_id, h, len(h) // 2 as n from d),
w as (select rid, unnest(range(0, n - 99)) as i from s),
k as (select w.rid, w.i, md5(substr(s.h, 2 * w.i + 1, 200)) as m from w join s on w.rid = s.rid),
again as (select rid, i from k qualify row_number() over (partition by m order by rid, i) > 1),
a as (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 100 then 0 else 1 end as new from again),
b as (select rid, i, sum(new) over (partition by rid order by i) as span from a),
p as (select rid, span, min(i) as i0, max(i) + 100 as i1 from b group by rid, span),
g as (select rid, span, i0, i1, coalesce(lag(i1) over (partition by rid order by span), 0) as before from p),
r as (select g.rid, count(*) as spans, sum(i1 - i0) as removed, max(i1) as last, string_agg(substr(h, 2 * before + 1, 2 * (i0 - before)), '' order by span) as kept from g join s on g.rid = s.rid group by g.rid)
select doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans,
 sha256(unhex(case when r.rid is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256 from s left join r on s.rid = r.rid
"""

"""Cross-tokenizer alignment, by relational operators.

Where two tokenizers' tokens of a text both end, the text is cut; a group is what
lies between two cuts, and the tokens of a group whose byte ranges overlap are
linked. :func:`spans`, :func:`numbered` and :func:`linked` say this for tokens as
rows: positions become byte ranges by a windowed sum of lengths, an equi-join on
document and end finds the cuts, a running count of cuts numbers the groups, and a
range join within the groups gives the links.

A corpus has far too many tokens for a row each, but few that differ in what
matters. Both tokenizers cut before a blank or a line break that follows anything
but white space (:func:`cuts_words` looks through the vocabulary for tokens that
would not), so a text's alignment is that of its words one after the other, and a
word's alignment hangs on its tokens' lengths alone. So the relational plan runs
once for each distinct pair of length lists (a shape). Texts are written in parts of
bounded size: a part is one row with its words' tokens and shapes and its texts
as lists of word numbers. What is found out about shapes, and later about id pairs, is
joined to the parts that have them, so nothing is broadcast.

A pair of ids counts the documents that hold it linked. Parts count their own
documents; the counts are summed over parts and joined back.

Defined cases: a null or empty text, and one whose tokens' bytes aren't its own (a blank
that another sign stands for, say), has no tokens, so zeros and no groups;
special tokens' strings are plain text; rows that repeat are aligned each; an
empty table gives no rows; columns other than the two are ignored, whatever their
names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, drop, small_batches, stored, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text in a part, which a task holds.
PART_CHARS = 6 << 20
#: A word ends before a blank or a line break that follows something else than white space.
_WORDS = re.compile(r"(?<=\S)(?=[ \n])")
#: White space of other kinds, or two of it in a row: such texts are cut by :data:`_WORDS`, others at every blank and line break.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]")
_SPACE = "▁"


# Tokens as rows


def spans(tokens: DataFrame) -> DataFrame:
    """``doc, i, n`` (place and length of each token) with the byte range ``start`` to ``end``."""
    end = F.sum("n").over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))


def numbered(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tokenizers' spans with the group ``g`` that each token is in: the number of cuts before it."""
    cuts = a.select("doc", "end").join(b.select("doc", "end"), ["doc", "end"]).withColumn("cut", F.lit(1))
    before = Window.partitionBy("doc").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)

    def of(x: DataFrame) -> DataFrame:
        return x.join(cuts, ["doc", "end"], "left").withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0))).drop("cut")

    return of(a), of(b)


def linked(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc, i, j``: token i of the first and j of the second have bytes in common."""
    b = b.select("doc", "g", F.col("i").alias("j"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a.join(b, ["doc", "g"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))).select("doc", "i", "j")


def aligned_shapes(shapes: DataFrame) -> DataFrame:
    """``shape`` (a number), groups (lists of places in both) and links (pairs of places) of every pair of length lists ``la, lb``."""
    shapes = cut(shapes.select("la", "lb").distinct().withColumn("doc", F.monotonically_increasing_id()))
    rows = lambda side: spans(shapes.select("doc", F.posexplode(side).alias("i", "n")))
    a, b = numbered(rows("la"), rows("lb"))
    a, b = stored(a), stored(b)
    places = lambda x, name: x.groupBy("doc", "g").agg(F.sort_array(F.collect_list("i")).alias(name))
    groups = places(a, "ga").join(places(b, "gb"), ["doc", "g"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("g", "ga", "gb"))).alias("groups"))
    links = linked(a, b).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("links"))
    out = stored(shapes.join(groups, "doc").join(links, "doc").withColumnRenamed("doc", "shape"))
    drop(a, b)
    return out


# Words and their tokens


def cut_up(text: str) -> list[str]:
    """The words of a blank and ``text``. The blank that a word begins with is left out, if no white space follows it."""
    whole = " " + text
    if not _ODD.search(whole):
        return text.replace("\n", " \n").split(" ")
    return [w if w[0] == "\n" or w[1:2].isspace() else w[1:] for w in _WORDS.split(whole)]


def whole_word(w: str) -> str:
    return w if w[:1] in (" ", "\n") and w else " " + w


class Tokenizers:
    """Ids and byte lengths of a word's tokens by both tokenizers. A word begins with a blank or a line break."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_file(a))
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(own)]
        byte_of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}
        self.quick = _by_ranks(self.a)
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=_file(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if not cuts_words(pieces):
            raise ValueError(f"{b} has pieces that go on beyond a word's end")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.blank = pieces.index(_SPACE)
        self.a_length, self.b_length = (np.array([*map(len, x)], dtype=np.int32) for x in (self.a_bytes, self.b_bytes))

    def of(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both for each word, and whether the tokens keep the word's bytes."""
        if self.quick is not None:
            firsts = list(map(self.quick.encode_ordinary, words))
        else:
            firsts = [x.ids for x in self.a.encode_batch_fast(words, add_special_tokens=False)]
        # The second tokenizer puts a blank before what it gets. Before a line break, that is one token too many.
        seconds = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        kept = []
        for k, w in enumerate(words):
            if w == " ":  # nothing is left for the second tokenizer to put a blank before
                seconds[k] = [self.blank]
            elif w[0] != " ":
                seconds[k] = seconds[k][1:] if seconds[k][:1] == [self.blank] else []
            raw = w.encode("utf-8", "replace")
            same = raw == b"".join(map(self.b_bytes.__getitem__, seconds[k]))
            kept.append(same and (self.quick is not None or raw == b"".join(map(self.a_bytes.__getitem__, firsts[k]))))
        return firsts, seconds, kept


def _by_ranks(tokenizer):
    """The same byte-level tokenizer in a quicker form, or None if its merges don't stand in the order of their ids, as that form takes them."""
    import json

    import tiktoken

    told = json.loads(tokenizer.to_str())
    vocab, pre = told["model"].get("vocab", {}), told.get("pre_tokenizer") or {}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in told["model"].get("merges", [])]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not told.get("normalizer")
    if not plain or None in merged or merged != sorted(merged):
        return None
    special = {t["content"] for t in told.get("added_tokens", [])}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(own))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    # Fixed value: how byte-level tokenizers of this kind cut a text before they merge.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts_words(pieces: list[str]) -> bool:
    """Whether no piece has a blank or a line break after something else than white space."""
    return not any(re.search(r"[^\s▁][ \n▁]", p) for p in pieces)


def _file(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Tokenizers(a, b)
    return _LOADED[a, b]


class Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_INTS = ("refs", "ends", "ia", "ea", "ib", "eb", "shape")


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: how many, then packed."""
    raw = np.ascontiguousarray(x, dtype="<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _read_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), dtype="<i4")


class Part:
    """Texts that are being written: as numbers of words, which are tokenized when the part is full."""

    def __init__(self):
        self.words, self.ids, self.refs, self.size = Numbers(), [], [], 0

    def add(self, doc_id: pa.Scalar, text: str | None) -> None:
        words = cut_up(text) if text else []
        self.ids.append(doc_id)
        self.refs.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.size += len(text or "")

    def columns(self, both: Tokenizers) -> tuple[list[bytes], list[list[int]], list[list[int]]]:
        """The columns of :data:`_INTS`, and the length lists of the part's shapes. A word whose bytes the tokens don't keep has the shape -1."""
        ids, ends, shapes, shape = ([], []), ([0], [0]), {}, []
        words = list(map(whole_word, self.words))
        for at in range(0, len(words), 4096):
            *found, kept = both.of(words[at : at + 4096])
            cut_at = []
            for side, (lists, length) in enumerate(zip(found, (both.a_length, both.b_length))):
                flat = np.fromiter(chain.from_iterable(lists), np.int32)
                stop = np.cumsum([*map(len, lists)])
                ids[side].append(flat)
                ends[side].extend((stop + ends[side][-1]).tolist())
                raw, stop = length[flat].astype("<u2").tobytes(), (2 * stop).tolist()
                cut_at.append([raw[i:j] for i, j in zip([0, *stop], stop)])
            # Lengths of both, with their number first, say what the shape is.
            shape += [shapes.setdefault((x, y), len(shapes)) if ok else -1 for x, y, ok in zip(*cut_at, kept)]
        a, b = (np.concatenate(x) if x else np.empty(0) for x in ids)
        texts = np.concatenate(self.refs) if self.refs else np.empty(0)
        blobs = [texts, np.cumsum([0, *map(len, self.refs)]), a, np.array(ends[0]), b, np.array(ends[1]), np.array(shape)]
        lists = [[np.frombuffer(x[k], dtype="<u2").tolist() for x in shapes] for k in (0, 1)]
        return [*map(_ints, blobs)], *lists


def _parts(docs: DataFrame, a: str, b: str, part_chars: int) -> DataFrame:
    """A row a part: ``part`` (a number), ``ids`` of its documents, the columns of :data:`_INTS`, and ``la, lb``, the length lists of its shapes."""
    small_batches(docs.sparkSession)
    many = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in _INTS], T.StructField("la", many), T.StructField("lb", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = TaskContext.get().partitionId() << 24, Part()
        both = _tokenizers(a, b)

        def made(kind: pa.DataType) -> pa.RecordBatch:
            blobs, la, lb = part.columns(both)
            lists = [pa.array([x], pa.list_(pa.list_(pa.int32()))) for x in (la, lb)]
            ids = pa.array([[x.as_py() for x in part.ids]], pa.list_(kind))
            return pa.RecordBatch.from_arrays([pa.array([number]), ids, *[pa.array([x], pa.binary()) for x in blobs], *lists], names=schema.names)

        kind = None
        for x in batches:
            kind = x.schema.field(0).type
            for doc_id, text in zip(x.column(0), x.column(1)):
                part.add(doc_id, text.as_py())
                if part.size >= part_chars:
                    yield made(kind)
                    number, part = number + 1, Part()
        if part.ids:
            yield made(kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _shapes_of(parts: DataFrame) -> DataFrame:
    """``part, found``: for each of a part's shapes its number there, its groups as text of places and its links as a list of places in turn."""
    used = parts.select("part", F.posexplode(F.arrays_zip("la", "lb")).alias("k", "s")).select("part", "k", "s.la", "s.lb")
    shapes = aligned_shapes(used)
    places = lambda of: F.array_join(F.transform(of, lambda i: i.cast("string")), ",")
    form = F.array_join(F.transform("groups", lambda g: F.concat(places(g["ga"]), F.lit("|"), places(g["gb"]))), ";")
    links = F.flatten(F.transform("links", lambda x: F.array(x["i"], x["j"])))
    told = used.join(shapes.select("la", "lb", form.alias("form"), links.alias("links")), ["la", "lb"])
    found = stored(told.groupBy("part").agg(F.collect_list(F.struct("k", "form", "links")).alias("found")))
    drop(shapes)
    return found


class Words:
    """A part's words: their tokens, shapes and links, as arrays."""

    def __init__(self, row: pa.RecordBatch):
        self.ids = row.column("ids").flatten()
        raw = {c: _read_ints(row.column(c)[0].as_py()) for c in _INTS}
        self.refs, self.ends, self.ia, self.ea, self.ib, self.eb, self.shape = (raw[c] for c in _INTS)
        found = row.column("found").flatten()
        k, forms, links = (found.field(i) for i in range(3)) if len(found) else (pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
        n = int(self.shape.max()) + 1 if len(self.shape) else 0
        order = np.zeros(n, dtype=np.int64)
        order[k.to_numpy()] = np.arange(len(k))
        self.forms = [forms[int(i)].as_py() for i in order]
        flat, size = links.flatten().to_numpy(), links.value_lengths().to_numpy() // 2
        begin = np.cumsum(size) - size
        self.ok = self.shape >= 0
        s = np.maximum(self.shape, 0)
        self.n_links = np.where(self.ok, size[order[s]], 0) if n else np.zeros(len(self.shape), dtype=np.int64)
        self.n_groups = np.where(self.ok, np.array([f.count(";") + 1 for f in self.forms])[s], 0) if n else self.n_links
        # The links of all words one after the other: where each word's begin, and their ids.
        self.first = np.cumsum(self.n_links) - self.n_links
        word = np.repeat(np.arange(len(self.shape)), self.n_links)
        at = (np.repeat(begin[order[s]] if n else s, self.n_links) + np.arange(len(word)) - self.first[word]) * 2
        self.pairs = (self.ia[self.ea[word] + flat[at]].astype(np.int64) << 32) + self.ib[self.eb[word] + flat[at + 1]]

    def texts(self) -> Iterator[np.ndarray | None]:
        """Each document's words; None if it has none, or one whose bytes the tokens don't keep."""
        for i, j in zip(self.ends[:-1].tolist(), self.ends[1:].tolist()):
            refs = self.refs[i:j]
            yield refs if j > i and self.ok[refs].all() else None

    def groups(self) -> list[str]:
        """The groups of each word as text."""
        made, out = {}, []
        ia, ea, ib, eb = (x.tolist() for x in (self.ia, self.ea, self.ib, self.eb))
        for w, s in enumerate(self.shape.tolist()):
            if s < 0:
                out.append("")
                continue
            if s not in made:
                places = [(int(x), side) for g in self.forms[s].split(";") for side, t in enumerate(g.split("|")) for x in t.split(",")]
                n_a = sum(side == 0 for _, side in places)
                made[s] = re.sub(r"\d+", "%d", self.forms[s]), [x + side * n_a for x, side in places]
            template, order = made[s]
            ids = ia[ea[w] : ea[w + 1]] + ib[eb[w] : eb[w + 1]]
            out.append(template % tuple([ids[i] for i in order]))
        return out


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1)


def _pair_counts(parts: DataFrame) -> DataFrame:
    """``part, pairs, docs``: the distinct id pairs of each part, and how many of its documents have each linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            w = Words(row)
            pairs, local = np.unique(w.pairs, return_inverse=True)
            docs = np.zeros(len(pairs), dtype=np.int64)
            for refs in w.texts():
                if refs is not None:
                    u = np.unique(refs)
                    n = w.n_links[u]
                    places = np.repeat(w.first[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    docs[np.unique(local[places])] += 1
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs[docs > 0], docs[docs > 0])]
            yield pa.RecordBatch.from_arrays([row.column("part"), *lists], names=["part", "pairs", "docs"])

    return parts.mapInArrow(run, "part long, pairs array<long>, docs array<long>")


VALUES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _assembled(parts: DataFrame) -> DataFrame:
    """The values of every document as sums of its words', and its ``groups``. Parts have ``known``: the counts of their id pairs and whether they are best."""
    key = parts.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", key), *[T.StructField(c, T.LongType()) for c in VALUES], T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            w = Words(row)
            known = row.column("known").flatten()
            pair, docs, best = (known.field(i).to_numpy() for i in range(3)) if len(known) else [np.empty(0, dtype=np.int64)] * 3
            order = np.argsort(pair)
            # Pairs that only stand in texts without tokens are counted nowhere.
            at = np.minimum(np.searchsorted(pair[order], w.pairs), max(0, len(pair) - 1))
            hit = pair[order][at] == w.pairs if len(pair) else np.zeros(len(w.pairs), dtype=bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[order][at], 0) if len(pair) else hit)]) for x in (best, docs)]
            of_words = np.stack([np.diff(w.ea), np.diff(w.eb), w.n_groups, w.n_links, *[s[w.first + w.n_links] - s[w.first] for s in sums]], axis=1).astype(np.int64)
            groups, texts = w.groups(), list(w.texts())
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                values = np.array([np.zeros(len(VALUES), dtype=np.int64) if t is None else of_words[t].sum(axis=0) for t in some]).reshape(-1, len(VALUES))
                joined = ["" if t is None else ";".join([groups[k] for k in t.tolist()]) for t in some]
                yield pa.RecordBatch.from_arrays([w.ids.slice(i, len(some)), *[pa.array(values[:, k]) for k in range(len(VALUES))], pa.array(joined, pa.string())], names=schema.names)

    return parts.mapInArrow(run, schema)


def aligned(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id``, the values and the ``groups`` of every document of ``docs`` (``doc_id, text``).

    ``groups`` is text, as ``a1,a2|b1;a3|b2,b3``.
    """
    parts = stored(_parts(docs, a, b, part_chars))
    found = _shapes_of(parts)
    # Met twice rather than written once more: a part is the larger side.
    parts = parts.drop("la", "lb").join(found, "part", "left")
    counts = stored(_pair_counts(parts))
    rows = counts.select("part", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("part", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    whole = cut(rows.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)))
    top = whole.groupBy("a").agg(F.max("docs").alias("top"))
    scored = whole.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).cast("long").alias("best"))
    known = rows.select("part", "pair").join(scored, "pair").groupBy("part").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("known"))
    return _assembled(parts.join(known, "part", "left"))


def op11_relational_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *VALUES, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))

"""Cross-tokenizer alignment against both tokenizers on whole texts and a plain walk over their bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orestrata.llm import alignment as L

A = Tokenizer.from_file(str(public_tokenizers.path(L.TOKENIZER_A)))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(L.TOKENIZER_B)))
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(x): x for x in _OWN} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in _OWN)}


def tokens(text):
    """(id, bytes) of both, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(_BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def ends(ts):
    at, out = 0, []
    for i, x in ts:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(texts):
    docs, counts = [], Counter()
    for text in texts:
        a, b = map(ends, tokens(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links, x, y = [], [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while x < len(a) and a[x][2] <= c:
                ga.append(a[x])
                x += 1
            while y < len(b) and b[y][2] <= c:
                gb.append(b[y])
                y += 1
            groups.append(",".join(str(i) for i, _, _ in ga) + "|" + ",".join(str(i) for i, _, _ in gb))
            links += [(i, j) for i, s, e in ga for j, t, f in gb if s < f and t < e]
        counts.update(set(links))
        docs.append((len(a), len(b), groups, links))
    top = Counter()
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [(na, nb, len(g), len(l), sum(counts[p] == top[p[0]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, l in docs]


COLUMNS = [*L.VALUES, "groups_sha256"]
ODD = ["", None, " ", "  two  blanks ", "a\n\nb\n c\t d\r\n", "tab\tand\xa0nbsp  em", "▁odd", "<|endoftext|> <s> </s> <0x41>", "日本語のテキスト 漢字", "🙂🙃 👩‍👩‍👧", "ﬁ ligature", "don't we'll", "x" * 3000, "\x00nul", "1234567890 12,345.67", "é é", "a\x1c b\x85 c", " line sep", "word " * 500]


def same_tokens(both, text):
    words = [L.whole_word(w) for w in L.cut_up(text)]
    assert words == L._WORDS.split(" " + text) and len({*words}) == len({*L.cut_up(text)})
    firsts, seconds, kept = both.of(words)
    a, b = tokens(text)
    assert all(kept) == bool(a)
    if a:
        assert [i for ids in firsts for i in ids] == [i for i, _ in a]
        assert [i for ids in seconds for i in ids] == [i for i, _ in b]


@pytest.mark.parametrize("quick", [True, False])
def test_words_are_tokenized_as_in_texts(quick):
    both = L.Tokenizers(L.TOKENIZER_A, L.TOKENIZER_B)
    assert both.quick is not None
    both.quick = both.quick if quick else None
    for text in filter(None, ODD):
        same_tokens(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z\n\t\r é'1.,▁日　\x1c!"), min_size=1, max_size=30))
def test_words_of_random_texts(text):
    both = L._tokenizers(L.TOKENIZER_A, L.TOKENIZER_B)
    same_tokens(both, text)


def test_pieces_beyond_a_word_are_seen():
    assert L.cuts_words(["▁▁", "▁a", "a", ";\r", "\n"])
    assert not L.cuts_words(["a▁"]) and not L.cuts_words(["a\n"])


def test_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in L.op11_relational_alignment(spark, sf_dir).collect()}
    assert got == dict(zip((r.doc_id for r in rows), plain([r.text for r in rows])))


@pytest.mark.parametrize("limits", [{}, {"part_chars": 50}])
def test_defined_cases(spark, limits):
    rows = [(k, t) for k, t in enumerate(ODD + ["same text", "same text"])] + [(None, "no id"), (3, "an id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "2 as part", "'x' as word", "3 as kind", "'y' as groups")
    out = L.aligned(df.repartition(3), **limits).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, *(r[c] for c in L.VALUES), hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in out))
    assert got == sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))


def test_empty_table(spark):
    assert L.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_as_rows(spark):
    """The relational plan by itself: abc|de f against ab|cde f."""
    a = spark.createDataFrame([("x", 0, 3), ("x", 1, 2), ("x", 2, 1)], "doc string, i int, n int")
    b = spark.createDataFrame([("x", 0, 2), ("x", 1, 3), ("x", 2, 1)], "doc string, i int, n int")
    ga, gb = L.numbered(L.spans(a), L.spans(b))
    assert [(r.i, r.g) for r in ga.orderBy("i").collect()] == [(0, 0), (1, 0), (2, 1)]
    assert sorted((r.i, r.j) for r in L.linked(ga, gb).collect()) == [(0, 0), (0, 1), (1, 1), (2, 2)]

"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

Every node (element or block of text) gets the probability that it holds main
text. Decoding picks the most probable labelling in which a node without main
text has none below it and a node with main text has it in all ancestors, so a
kept block never lies in a rejected container. Kept blocks are joined in page
order.

The pages carry no labels. The trees are fitted on a bounded sample of pages:
there the article or main element (or, without one, long paragraphs with few
links) is taken for main text, and each sampled page is also laid out anew in
several ways: other elements and attribute words around the same text, with
menus, headers, sidebars, notices, adverts, forms and reader comments added, so
that the trees don't hang on one layout.

Defined cases: a null or empty html gives an empty text; html is read whole;
broken markup is read as far as it goes; a page whose blocks are all rejected has
an empty text; repeated rows are extracted alike; without a page to learn from
every text is empty; an empty table gives no rows; other columns are kept by
``extract`` and never read, but one named ``main_text`` is replaced.
"""

from __future__ import annotations

import html as entities
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import sample, small_batches, table
from orestrata.llm.dom import FEATURES, Node, node_features, parse
from orestrata.llm.trees import BoostedTrees, fit


@dataclass(frozen=True)
class HtmlParams:
    """``sample_pages`` bounds the pages that are learnt from (picked by a hash of the url and length, read whole),
    ``layouts`` how often each is laid out anew."""

    sample_pages: int = 120
    layouts: int = 6
    seed: int = 11


PARAMS = HtmlParams()


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The most probable consistent labelling. ``nodes`` are in page order, parents first."""
    n = len(nodes)
    yes, no = np.log(np.clip(p, 1e-6, 1 - 1e-6)), np.log(np.clip(1 - p, 1e-6, 1 - 1e-6))
    without = no.copy()  # the whole subtree without main text
    best = yes.copy()  # this node with main text, the children as is best
    for i in range(n - 1, 0, -1):
        q = nodes[i].parent.index
        without[q] += without[i]
        best[q] += max(best[i], without[i])
    keep = [False] * n
    for i in range(n):
        up = keep[nodes[i].parent.index] if nodes[i].parent is not None else True
        keep[i] = bool(up and best[i] > without[i])
    return keep


def joined(nodes: list[Node], keep: list[bool]) -> str:
    return "\n\n".join(x.text for x, k in zip(nodes, keep, strict=True) if k and x.text)


def weak_labels(nodes: list[Node]) -> list[bool]:
    """Whether a node holds main text, as far as a page's own markup tells."""
    marked = {i for i, x in enumerate(nodes) if x.tag in ("article", "main")}
    aside = {"nav", "aside", "footer", "form", "header"}
    leaf = []
    for x in nodes:
        inside, bad, q = False, False, x.parent
        while q is not None:
            inside |= q.index in marked
            bad |= q.tag in aside
            q = q.parent
        if marked:
            leaf.append(bool(x.text) and inside and not bad)
        else:
            leaf.append(bool(x.text) and not bad and x.text.count(" ") >= 40 and x.link_chars * 3 < len(x.text))
    return _upward(nodes, leaf)


def _upward(nodes: list[Node], leaf: list[bool]) -> list[bool]:
    out = list(leaf)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent.index] = True
    return out


# How a page can be laid out. Each pair is an element and its attributes.
_MAIN = [("article", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body entry"'), ("main", ""), ("section", 'class="story"'), ("div", ""), ("article", 'class="post"')]
_MENU = [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="navigation"'), ("div", 'id="breadcrumbs"'), ("nav", 'class="navbar"')]
_HEAD = [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("header", 'class="site-header"')]
_FOOT = [("footer", ""), ("div", 'class="footer"'), ("div", 'id="copyright"'), ("footer", 'class="site-footer"')]
_SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="related widget"'), ("section", 'class="trending"'), ("aside", 'class="rail"')]
_ADS = [("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'id="sponsored"'), ("section", 'class="promo"'), ("p", 'class="ads"'), ("aside", 'class="advertisement"')]
_NOTES = [("div", 'class="cookie-notice"'), ("div", 'class="alert"'), ("section", 'id="newsletter"'), ("div", 'role="dialog" class="consent"'), ("div", 'class="notice"'), ("p", 'class="notice"')]
_TALK = [("div", 'class="comments"'), ("section", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'id="respond"'), ("div", 'class="reader-comments"')]
_FORM = [("form", ""), ("form", 'class="search"'), ("div", 'class="login-form"'), ("form", 'id="contact"')]


def layout(blocks: list[str], pool: list[str], rng: random.Random) -> tuple[str, set[str]]:
    """A page around ``blocks`` (main text) with the rest taken from ``pool``; and the main texts.

    Main blocks carry a mark in an attribute that no feature reads.
    """
    esc = lambda s: entities.escape(s, quote=False)
    some = lambda lo, hi: " ".join(rng.choice(pool).split()[: rng.randint(lo, hi)]) or "more"
    wrap = lambda kinds, inner: (lambda t: f"<{t[0]} {t[1]}>{inner}</{t[0]}>")(rng.choice(kinds))
    link = lambda: f'<a href="#">{esc(some(1, 4))}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    para = lambda lo, hi: f"<p>{esc(some(lo, hi))}</p>"
    prose = lambda lo, hi: rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<p><small>{}</small></p>", "<div>{}</div>"]).format(esc(some(lo, hi)))
    comments = lambda: "".join(rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<div><b>{}</b></div>"]).format(para(3, 60)) for _ in range(rng.randint(1, 5)))
    form = lambda: wrap(_FORM, f"<label>{esc(some(1, 3))}</label><input><p>{esc(some(2, 14))}</p><button>{esc(some(1, 2))}</button>")

    body = []
    for i, b in enumerate(blocks):
        t = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p"] * 8 + ["h2", "blockquote", "div", "li", "pre"])
        x = f"<{t} data-main=1>{esc(b)}"
        body.append(x + ("" if t == "p" and rng.random() < 0.1 else f"</{t}>"))
        if rng.random() < 0.15:
            body.append(rng.choice([wrap(_ADS, prose(2, 25)), wrap(_NOTES, prose(4, 25)), wrap(_SIDE, links(3))]))
    inner = "".join(body)
    for _ in range(rng.randint(0, 2)):
        inner = wrap(_MAIN, inner) if rng.random() < 0.5 else f"<{rng.choice(['div', 'section'])}>{inner}</div></section>"
    if rng.random() < 0.3:
        inner += rng.choice([wrap(_TALK, comments()), '<div class="share">' + link() + link() + "</div>"])
    main = wrap(_MAIN, inner)
    top = [wrap(_HEAD, prose(1, 20) + rng.choice(["", links(4)]))] if rng.random() < 0.6 else []
    top += [wrap(_MENU, links(rng.randint(2, 12)))] if rng.random() < 0.8 else []
    top += [wrap(_NOTES, prose(4, 45))] if rng.random() < 0.4 else []
    top += [wrap(_ADS, prose(1, 45))] if rng.random() < 0.5 else []
    top += [form()] if rng.random() < 0.2 else []
    low = [wrap(_SIDE, rng.choice([links(5), para(5, 60), "<h3>" + esc(some(1, 5)) + "</h3>" + links(4)]))] if rng.random() < 0.5 else []
    low += [wrap(_TALK, "<h3>" + esc(some(1, 3)) + "</h3>" + comments())] if rng.random() < 0.5 else []
    low += [form()] if rng.random() < 0.3 else []
    low += [wrap(_ADS, prose(1, 45))] if rng.random() < 0.3 else []
    low += [wrap(_FOOT, prose(2, 35) + rng.choice(["", links(3)]))] if rng.random() < 0.85 else []
    rng.shuffle(top)
    if rng.random() < 0.3 and low:
        top.append(low.pop(0))
    page = "".join(top) + main + "".join(low)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
    return f"<html><head><title>{esc(blocks[0][:60])}</title></head><body>{page}", {" ".join(b.split()) for b in blocks}


def learn(pages: DataFrame, p: HtmlParams = PARAMS) -> BoostedTrees:
    """Fit the trees on ``sample_pages`` pages, which come to the driver."""
    known = pages.where("html is not null")
    rows = sample(known.select("url", "html"), known.select("url").count(), p.sample_pages, "url", F.length("html"), seed="html").collect()
    rng = random.Random(p.seed)
    seen = []
    for r in sorted(r["html"] for r in rows):
        nodes = parse(r)
        labels = weak_labels(nodes)
        seen.append((nodes, labels))
    pool = [x.text for nodes, _ in seen for x in nodes if x.text] or ["text"]
    xs, ys = [np.zeros((0, len(FEATURES)), dtype=np.float32)], [np.zeros(0)]
    for nodes, labels in seen:
        xs.append(node_features(nodes))
        ys.append(np.array(labels, dtype=float))
        blocks = [x.text for x, k in zip(nodes, labels, strict=True) if k and x.text]
        if not blocks:
            continue
        for _ in range(p.layouts):
            lo = rng.randrange(len(blocks))
            page, main = layout(blocks[lo : lo + rng.choice([1, 2, 4, 8, 16, 30])], pool, rng)
            new = parse(page)
            xs.append(node_features(new))
            ys.append(np.array(_upward(new, _marked(new, main)), dtype=float))
    return fit(np.vstack(xs), np.concatenate(ys))


def _marked(nodes: list[Node], main: set[str]) -> list[bool]:
    """Blocks that repeat a main text and stand where main text stands (not below a frame)."""
    frames = {"nav", "aside", "footer", "form", "header"}
    out = []
    for x in nodes:
        ok, q = bool(x.text) and x.text in main, x.parent
        while ok and q is not None:
            ok = q.tag not in frames
            q = q.parent
        out.append(ok)
    return out


def extract(pages: DataFrame, model: BoostedTrees, column: str = "html") -> DataFrame:
    """``pages`` with ``main_text``."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.drop("main_text")
    at = pages.columns.index(column)
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = []
            for lo in range(0, b.num_rows, 64):
                trees = [parse(v.as_py()) for v in b.column(at).slice(lo, 64)]
                p = m.probability(np.vstack([node_features(t) for t in trees]))
                ends = np.cumsum([len(t) for t in trees])
                texts += [joined(t, decode(t, p[e - len(t) : e])) for t, e in zip(trees, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return pages.mapInArrow(run, schema)


def op8_dom_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    model = learn(pages)
    return extract(pages.select("page_id", "url", "html"), model).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )

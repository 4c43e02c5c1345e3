"""Operator 3, main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, with the open tags and their class and id words.
Each block is described by its ancestors and by its text (length, share of linked text, punctuation, neighbours); the
field scores labels along the page (main or not) with weights for features and for pairs of labels, and Viterbi's
algorithm picks the best labelling. Weights are trained here by maximum likelihood (forward-backward over padded
batches) on labelled pages: by default pages written by ``labelled_pages`` in many layouts, or pages of one's own.

Scripts, styles, templates and comments hold no text. White space (line breaks within a block too) becomes one space,
character references are decoded, blocks are joined by an empty line.

Defined results: null html counts as empty and gives an empty text; a page without main blocks gives an empty text;
unclosed tags end where a block of the same kind or their parent ends, and an unclosed head at the first tag or word that
does not belong there; a page cut off in a tag ends there; ties between labels go to "not main"; repeated rows are
extracted alike, an empty table gives no rows, and a long page is read in time that grows with its length. An input column
named text or n_chars gives way to the result.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .common import append_columns

# fixed values: kinds of tags
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template iframe svg math object canvas audio video select head title textarea".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = set("article main nav aside footer header form section blockquote figure".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What may stand in a head.
HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def leaf_blocks(page: str) -> list[tuple[list[str], str, float]]:
    """(marks of the open tags, text, share of linked text) of each block with text, in page order."""
    out: list[tuple[list[str], str, float]] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = 0
    n, pos, quiet, anchor = len(page), 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                marks: list[str] = []
                for i, (tag, names) in enumerate(reversed(stack)):
                    marks.append(("tag:" if i == 0 else "in:") + tag)
                    marks += names
                out.append((list(dict.fromkeys(marks)), text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def close(to: int) -> None:
        nonlocal quiet, anchor
        while len(stack) > to:
            tag = stack.pop()[0]
            if tag in SILENT:
                quiet -= 1
            if tag == "a":
                anchor -= 1

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            chunk = m.group()
            if chunk[0] != "<" or chunk == "<":
                if quiet and stack[-1][0] == "head" and not chunk.isspace():
                    close(len(stack) - 1)
                if not quiet:
                    text = _html.unescape(chunk)
                    parts.append(text)
                    if anchor:
                        linked += len(text)
            continue
        if not m.group(4):
            break  # cut off in this tag
        tag = tag.lower()
        if stack and stack[-1][0] == "head" and tag not in HEAD and (not m.group(1) or tag in ("body", "html", "br")):
            close(len(stack) - 1)
        if m.group(1):
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break  # a stray end of an inline tag does not close blocks
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends = CLOSES.get(tag, {"p"} if tag in BLOCK else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in ("b", "i"):
                    break
        if tag in VOID:
            continue
        attributes = m.group(3)
        names: list[str] = []
        if "=" in attributes:
            for found in _NAMES.findall(attributes):
                names += ["name:" + w for w in _WORD.findall("".join(found).lower())]
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = end.start() if end else n
        stack.append((tag, names))
        quiet += tag in SILENT
        anchor += tag == "a"
    flush()
    return out


def _bucket(n: int) -> int:
    return n.bit_length()


def describe(blocks: list[tuple[list[str], str, float]]) -> list[list[str]]:
    """Features of each block."""
    own: list[list[str]] = []
    total = len(blocks)
    for i, (marks, text, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        scope = next((m for m in marks if m.startswith("name:") or m.partition(":")[2] in SECTIONS), "none")
        own.append([
            *marks,
            f"scope {scope}",
            f"words:{min(_bucket(words), 7)}",
            f"linked:{int(linked * 3.99)}",
            f"stops:{min(3, text.count('. ') + text.count('! ') + text.count('? '))}",
            "ends:" + ("stop" if text[-1] in ".!?…\"”»" else "colon" if text[-1] == ":" else "other"),
            "copy" if "©" in text or "(c)" in text.lower() else "plain",
            f"place:{min(3, 4 * i // total)}",
            "bias",
        ])
    out = []
    for i, f in enumerate(own):
        before = [f"prev {x}" for x in own[i - 1] if x.startswith(("words", "linked", "tag"))] if i else ["first"]
        after = [f"next {x}" for x in own[i + 1] if x.startswith(("words", "linked", "tag"))] if i + 1 < total else ["last"]
        out.append(f + before + after)
    return out


class Field:
    """Weights of a two-label linear chain: per feature the lead of "main", and per pair of labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def label(self, features: list[list[str]]) -> list[bool]:
        """Viterbi."""
        get = self.weights.get
        (aa, ab), (ba, bb) = self.pairs.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, fs in enumerate(features):
            lead = sum(get(f, 0.0) for f in fs)
            if i:
                from_zero, from_one = (zero + aa >= one + ba), (zero + ab >= one + bb)
                back.append((0 if from_zero else 1, 0 if from_zero and from_one or from_one else 1))
                zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + lead
            else:
                one = lead
        if not features:
            return []
        state = int(one > zero)
        labels = [state]
        for b in reversed(back):
            state = b[state]
            labels.append(state)
        return [bool(x) for x in reversed(labels)]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, ridge: float = 1e-4, rate: float = 0.2) -> Field:
    """pages: html and a label for each of its leaf blocks. Maximum likelihood with a ridge, by Adam on all pages."""
    described = [(describe(leaf_blocks(p)), y) for p, y in pages]
    described = [(f, y) for f, y in described if f and len(f) == len(y)]
    seen: dict[str, int] = {}
    for fs, _ in described:
        for f in fs:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}
    count, longest = len(described), max(len(f) for f, _ in described)
    x = np.zeros((count, longest, len(index)), np.float32)
    y, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for i, (fs, labels) in enumerate(described):
        for t, f in enumerate(fs):
            x[i, t, [index[k] for k in f if k in index]] = 1
            y[i, t], real[i, t] = labels[t], True
    flat = x.reshape(-1, len(index))
    theta, pairs = np.zeros(len(index)), np.zeros((2, 2))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (theta, pairs)]
    rows = np.arange(count)
    total = real.sum()
    gold_pairs = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        lead = (flat @ theta.astype(np.float32)).reshape(count, longest).astype(float)
        score = np.stack([np.zeros_like(lead), lead], axis=2)
        alpha = np.zeros((count, longest, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead = np.logaddexp.reduce(alpha[:, t - 1][:, :, None] + pairs[None], axis=1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], ahead, alpha[:, t - 1])
        beta = np.zeros((count, longest, 2))
        for t in range(longest - 2, -1, -1):
            behind = np.logaddexp.reduce(pairs[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], behind, beta[:, t + 1])
        norm = np.logaddexp.reduce(alpha[rows, longest - 1], axis=1)
        marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - norm[:, None]) * real
        joint = np.exp(alpha[:, :-1, :, None] + pairs[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * both[:, :, None, None]
        slopes = [flat.T @ ((y * real - marginal).ravel().astype(np.float32)) / total - ridge * theta, (gold_pairs - joint.sum(axis=(0, 1))) / total - ridge * pairs]
        for value, slope, (m, v) in zip((theta, pairs), slopes, moments, strict=True):
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            v += 0.01 * slope**2
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({k: float(theta[i]) for k, i in index.items()}, pairs)


def labelled_pages(count: int = 1000, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages written in many layouts, with the label of each of their blocks."""
    rng = random.Random(seed)
    syllables = "the on er in an re tion de la que es en der ein ge ch ou eau ment pa lo mi ka sto ver ung il na su".split()
    pick, chance = rng.choice, rng.random

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def prose() -> str:
        out = []
        for _ in range(rng.randint(1, 6)):
            s = words(1, 18)
            s = s.upper() if chance() < 0.1 else s.capitalize()
            if chance() < 0.1:
                s = " ".join(w + pick(["!!", "***", " |", "%%%"]) for w in s.split())
            out.append(s + pick([".", ".", ".", "!", "?", ""]))
        text = " ".join(out)
        if chance() < 0.25:
            w = text.split()
            i = rng.randrange(len(w))
            w[i] = pick([f"<b>{w[i]}</b>", f"<i>{w[i]}</i>", f'<a href="/x">{w[i]}</a>', f"{w[i]}<br>", f"{w[i]} &amp; co", f"<span>{w[i]}</span>"])
            text = " ".join(w)
        return text

    def block(tag: str, text: str, attr: str = "", closed: bool = True) -> str:
        return f"<{tag}{attr}>{text}" + (f"</{tag}>" if closed else "")

    def menu(tag: str, names: list[str]) -> list[tuple[str, bool]]:
        attr = f' class="{pick(names)}"' if chance() < 0.6 else f' id="{pick(names)}"' if chance() < 0.4 else ""
        items = "".join(block("li", block("a", words(1, 2).title(), ' href="/m"')) for _ in range(rng.randint(2, 9)))
        return [(f"<{tag}{attr}><ul>{items}</ul></{tag}>", False)]

    def side(tag: str, names: list[str], texts: list[str], attr: str | None = None) -> list[tuple[str, bool]]:
        attr = f' class="{pick(names)}"' if attr is None else attr
        return [(f"<{tag}{attr}>{''.join(texts)}</{tag}>", False)]

    out = []
    for _ in range(count):
        parts: list[tuple[str, bool]] = []
        if chance() < 0.4:
            parts += side("header", ["header", "masthead", "site-header", "top"], [block(pick(["p", "div", "h1"]), words(1, 4).title())], pick(["", None, ' id="header"']))
        if chance() < 0.85:
            parts += menu(pick(["nav", "nav", "div"]), ["nav", "menu", "navigation", "navbar", "breadcrumb", "topnav"])
        if chance() < 0.35:
            parts += side("div", ["cookie", "cookie-notice", "banner", "consent", "notice", "alert", "popup"], [block("p", words(5, 25).capitalize() + "."), block("button", words(1, 2))])
        if chance() < 0.7:
            parts += side(pick(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "sponsored", "promo", "advertisement"], [pick([prose(), block("p", prose())])])
        if chance() < 0.25:
            parts += side("form", ["search", "newsletter", "subscribe", "login"], [block("label", words(1, 3)), '<input type="text">', block("button", words(1, 2))], pick(["", None]))
        body: list[tuple[str, bool]] = []
        if chance() < 0.8:
            body.append((block(pick(["h1", "h1", "h2"]), words(2, 12).capitalize()), True))
        if chance() < 0.2:
            body.append((block("p", pick(["By ", ""]) + words(2, 3).title(), pick(["", ' class="byline"'])), True))
        for _ in range(rng.randint(1, 9)):
            kind = chance()
            if kind < 0.72:
                body.append((block("p", pick(["", "", "<b>"]) + prose() + pick(["", "", "<br>"]), "", chance() < 0.8), True))
            elif kind < 0.8:
                body.append((block("h2", words(1, 7).capitalize()), True))
            elif kind < 0.86:
                body.append(("<ul>" + "".join(block("li", words(1, 14)) for _ in range(rng.randint(1, 5))) + "</ul>", True))
            elif kind < 0.91:
                body.append((block("blockquote", prose()), True))
            elif kind < 0.94:
                body.append((block("pre", words(2, 20)), True))
            elif kind < 0.97:
                body.append(("<table>" + "".join("<tr>" + "".join(block("td", words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>", True))
            else:
                body += side(pick(["div", "aside"]), ["ad", "advert", "related", "share", "promo", "sidebar"], [block("p", prose())])
        shell = pick(['<article>|</article>'] * 4 + ['|', '<main>|</main>', '<div class="content">|</div>', '<div id="main">|</div>', '<div class="post entry">|</div>', '<section class="story article">|</section>', '<main><article>|</article></main>', '<div class="article-body">|</div>']).split("|")
        if chance() < 0.06:  # a page that is nothing but its text
            parts, shell = [], ["", ""]
        alone = not parts and not shell[0]
        parts += [(shell[0], None), *body, (shell[1], None)]
        if not alone and chance() < 0.35:
            texts = [block(pick(["p", "div", "li"]), words(1, 3).title() + pick([": ", " "]) + prose()) for _ in range(rng.randint(1, 5))]
            parts += side(pick(["div", "section", "ol"]), ["comments", "comment", "discussion", "replies", "reader-comments"], [block("h3", "Comments"), *texts])
        if not alone and chance() < 0.35:
            parts += side(pick(["aside", "div"]), ["sidebar", "related", "widget", "recommended", "trending"], [block("h3", words(1, 3)), *(block("p", block("a", words(2, 8), ' href="/r"')) for _ in range(rng.randint(1, 5)))])
        if not alone and chance() < 0.85:
            texts = [pick(["&copy; ", "© ", ""]) + words(1, 3) + ".example.com" + pick([" &middot; ", " | ", ". "]) + prose()]
            parts += side(pick(["footer", "footer", "footer", "div"]), ["footer", "bottom", "site-footer", "copyright", "legal"], [texts[0] if chance() < 0.6 else block("p", texts[0])], None)
            if parts[-1][0].startswith("<footer") and chance() < 0.7:
                parts[-1] = (re.sub(r"<footer[^>]*>", "<footer>", parts[-1][0]), False)
        head = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        page = head + "".join(p for p, _ in parts) + pick(["</body></html>", "</body></html>", ""])
        labels: list[bool] = []
        for text, label in parts:
            if label is not None:
                labels += [label] * len(leaf_blocks(text))
        out.append((page, labels))
    return out


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on ``labelled_pages()``, once a process."""
    return train(labelled_pages())


def extract_page(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(text for (_, text, _), main in zip(blocks, field.label(describe(blocks)), strict=True) if main)


def extract(pages: DataFrame, field: Field, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.pairs))  # one number a feature

    def make():
        own = Field(*shared.value)

        def compute(texts: list) -> list[pa.Array]:
            out = [extract_page(t, own) for t in texts]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return compute

    return append_columns(pages, html_col, make, [StructField("text", StringType()), StructField("n_chars", LongType())], keep)

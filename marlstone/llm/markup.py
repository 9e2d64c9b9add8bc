"""Markup residue in text documents.

A text is read as a run of tokens, words and markup of four kinds. Every token
has a score, words above zero, structure (headings, lists, tables, code,
formulas, emphasis) at zero and other markup below; the contiguous run with the
greatest sum, found in one scan (maximum-scoring subsequence), is widened to
whole lines, blocks and structural elements and is the content. What is kept is then written as plain text with headings (``# ``), list items
(``- ``), fenced code and formulas in place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns

KINDS = ("html", "markdown", "wiki", "latex")

#: Element names of HTML.
ELEMENTS = """a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em
figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark meta nav
noscript object ol option p param pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td
template textarea tfoot th thead time title tr tt u ul var video""".split()
#: Commands of LaTeX that may stand without a brace.
BARE = """item alpha beta gamma delta epsilon lambda mu pi sigma theta omega cdot cdots ldots dots times log sum prod int infty leq geq neq approx
to rightarrow maketitle tableofcontents newpage noindent par hline centering bigskip medskip smallskip LaTeX TeX quad qquad left right""".split()

_ATTRIBUTE = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+)|\s+(?:disabled|checked|hidden|async|defer|selected|required|readonly))"""
#: Patterns of each kind under the literal that a match can't do without. What stands beside a sign is looked
#: at as Latin letters only: Han and kana have no space between word and markup.
_PARTS: dict[str, list[tuple[str, str]]] = {
    "html": [
        ("<!--", r"<!--(?s:.*?)(?:-->|\Z)"), ("<!", r"(?i:<!doctype[^<>]*>)"),
        ("<", rf"(?i:</?(?:{'|'.join(ELEMENTS)}){_ATTRIBUTE}*\s*/?>)"),
        ("&", r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ],
    "latex": [
        ("\\begin", r"\\begin\s*\{[^{}\n]*\}"), ("\\end", r"\\end\s*\{[^{}\n]*\}"),
        ("\\", rf"(?<![A-Za-z0-9_:\\])\\(?:{'|'.join(BARE)})(?![A-Za-z\\])"), ("\\", r"(?<!\\)~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{"),
        ("\\[", r"\\\[(?s:.+?)\\\]"), ("\\(", r"\\\((?s:.+?)\\\)"), ("$$", r"(?<![A-Za-z0-9_\\$])\$\$(?s:.+?)\$\$"),
        ("$", r"(?<![A-Za-z0-9_\\$])\$(?=[^\s$])(?=[^$\n]*[\\^_=+{}()])[^$\n]*[^\s$\\]\$(?![A-Za-z0-9_$])"),
    ],
    "wiki": [
        ("[[", r"\[\[[^\[\]\n]+\]\]"), ("{{", r"\{\{[^{}\n]+\}\}"), ("''", r"(?<!')'{2,5}(?=[^\s'])[^'\n]*(?:'[^'\n]+)*?'{2,5}(?!')"),
        ("==", r"(?m:^={2,6}[ \t]*[^=\s][^=\n]*?[ \t]*={2,6}[ \t]*$)"), ("{|", r"(?m:^\{\|.*$)"), ("|}", r"(?m:^\|\}[ \t]*$)"), ("|-", r"(?m:^\|-[ \t]*$)"),
        ("||", r"(?m:^\|(?![|-])[^\n]*\|\|[^\n]*$)"), ("!!", r"(?m:^![^\n]*!![^\n]*$)"), ("[http", r"\[https?://[^\s\]]+ [^\]\n]+\]"),
        ("<", r"(?i:</?(?:ref|nowiki|gallery)(?:\s[^<>]*)?/?>)"), ("TOC__", r"__(?:TOC|NOTOC|FORCETOC)__"),
    ],
    "markdown": [
        ("```", r"(?m:^ {0,3}`{3,}.*$)"), ("~~~", r"(?m:^ {0,3}~{3,}.*$)"), ("#", r"(?m:^ {0,3}#{1,6}[ \t]+\S.*$)"),
        ("===", r"(?m:^(?![ \t]*[|>{<\\])[^\n]*\w[^\n]*\n {0,3}={3,}[ \t]*$)"), ("---", r"(?m:^(?![ \t]*[|>{<\\])[^\n]*\w[^\n]*\n {0,3}-{3,}[ \t]*$)"),
        ("-", r"(?m:^ {0,3}-(?:[ \t]*-){2,}[ \t]*$)"), ("*", r"(?m:^ {0,3}\*(?:[ \t]*\*){2,}[ \t]*$)"), ("_", r"(?m:^ {0,3}_(?:[ \t]*_){2,}[ \t]*$)"),
        (">", r"(?m:^ {0,3}>[ \t]?\S)"), ("|", r"(?m:^[ \t]*\|(?!.*\|\|)[^\n]*[^|\s][ \t]*\|[ \t]*$)"), ("] ", r"(?m:^[ \t]*[-*+][ \t]+\[[ xX]\][ \t])"),
        ("`", r"(?<!`)(?:`[^`\n]+`|``(?!`)[^\n]+?(?<!`)``)(?!`)"), ("](", r"!?(?<![A-Za-z0-9_])\[[^\]\n]*\]\([^()\s]*(?:\([^()\s]*\))?(?:[ \t]+\"[^\"\n]*\")?\)"),
        ("][", r"(?<![A-Za-z0-9_\]])\[[^\]\[\n]+\]\[[^\]\[\n]*\]"), ("]:", r"(?m:^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$)"), ("[^", r"\[\^[^\]\s]+\]"),
        ("**", r"(?<![A-Za-z0-9_*])\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*(?!\*)|(?<=\w)\*\*(?=[^\s*])[^*\n]*?[^\s*]\*\*"), ("__", r"(?<![A-Za-z0-9_])__(?=[^\s_])[^\n]*?[^\s_]__(?![A-Za-z0-9_])"),
        ("*", r"(?<![A-Za-z0-9_*])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![A-Za-z0-9_*])"), ("_", r"(?<![A-Za-z0-9_/.])_(?=[^\s_])[^_\n]*?[^\s_]_(?![A-Za-z0-9_/.])"), ("~~", r"~~(?=[^\s~])[^~\n]*[^\s~]~~"),
        ("<http", r"<https?://[^\s<>]+>"),
    ],
}
_LITERALS = sorted({x for v in _PARTS.values() for x, _ in v})


@lru_cache(maxsize=4096)
def _finder(kind: str, held: tuple[str, ...]) -> re.Pattern[str] | None:
    """The patterns of a kind that a text with these literals may match."""
    parts = [f"(?:{p})" for x, p in _PARTS[kind] if x in held]
    return re.compile("|".join(parts)) if parts else None


#: A text without any of these signs holds no markup at all.
_SIGNS = re.compile(r"[<&\\$\[{|'=#*_`>~!]|^[ \t]*-", re.M)


def spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the markup in ``text``, without overlap, in order.

    Where kinds claim the same place the earlier in HTML, LaTeX, wiki, Markdown
    has it: their signs are the longer ones.
    """
    if not _SIGNS.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    held = tuple([x for x in _LITERALS if x in text])
    for kind in _PARTS:
        finder = _finder(kind, held)
        if finder is None:
            continue
        taken = sorted(found)
        at = 0
        for m in finder.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end() and taken[at][0] <= m.start():
                continue
            found.append((m.start(), m.end(), kind))
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and s[0] < out[-1][1]:
            # inside another one: it is markup all the same, of no width of its own
            out.append((out[-1][1], out[-1][1], s[2]))
        else:
            out.append(s)
    return out


#: Pages with their content marked by hand between the two signs, for the weights.
LABELLED = (
    "<div class=\"nav\"><a href=\"/a\">Home</a> <a href=\"/b\">Docs</a></div>«<p>The reader keeps its place when the file is opened again.</p>»<div><a href=\"/c\">Next</a></div>",
    "«<h1>Limits</h1><p>A shard holds many rows.</p><ul><li>one a day</li><li>two a night</li></ul>»<script>var a = 1;</script>",
    "<nav><ul><li><a href=\"/x\">x</a></li><li><a href=\"/y\">y</a></li></ul></nav>«# Start\nThe first step writes a table and reads it back.»",
    "«When the lease ends, the worker stops. It **must not** go on.»\n[[Category:Jobs]] {{nav}} [[a]] [[b]]",
)
_WORDS = re.compile(r"\w+")
#: Markup that carries structure or form scores nothing; links, references, layout and scripts stand around content more often.
_STRUCTURE = re.compile(
    r"</?(?:p|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|pre|code|kbd|samp|var|td|th|tr|table|thead|tbody|tfoot|caption|b|i|u|s|q|em|strong|small|mark|cite|del|ins|blockquote"
    r"|section|article|main|figure|figcaption|sub|sup)\b|&", re.I)
_AROUND = re.compile(r"!?\[(?!\[ xX]\][ \t])|<http|\{\{|</?(?:ref|nowiki|gallery)\b|__[A-Z]+TOC__|__TOC__|~?\\(?:cite|ref|label|pageref|eqref|bibliography|usepackage|documentclass)\b", re.I)
#: Between these tags a line goes on.
_INLINE = re.compile(r"</?(?:a|abbr|b|i|u|s|q|em|strong|small|big|mark|cite|del|ins|code|kbd|samp|var|sub|sup|span|font|img|time|tt|strike|label|input|button|select|option|ref|nowiki)\b|&|<!--", re.I)
_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)


def _tokens(text: str) -> list[tuple[int, int, str]]:
    marks = spans(text)
    if "<s" in text or "<S" in text:
        for m in _SCRIPT.finditer(text):  # a script is one tag, its words are none
            marks = sorted([x for x in marks if not m.start() <= x[0] < m.end()] + [(m.start(), m.end(), "html")])
    out, at = [], 0
    for start, end, kind in [*marks, (len(text), len(text), "")]:
        out += [(m.start() + at, m.end() + at, "word") for m in _WORDS.finditer(text[at:start])]
        if kind:
            piece = text[start:end]
            if kind == "html":
                out.append((start, end, "structure" if _STRUCTURE.match(piece) else "tag"))
            else:
                out.append((start, end, "mark" if _AROUND.match(piece) else "structure"))
                out += [(start, end, "word")] * len(_WORDS.findall(piece))
        at = max(at, end)
    return out


def best_run(scores: Sequence[float]) -> tuple[int, int]:
    """First and one past the last of the contiguous run with the greatest sum."""
    best, total, start, top = (0, 0), 0.0, 0, 0.0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > top:
            top, best = total, (start, i + 1)
    return best


#: What opens and closes an element that is kept whole: tags, environments, fences, tables of wiki.
_EDGE = re.compile(
    r"<(?P<shut>/?)(?P<tag>h[1-6]|li|ul|ol|dl|table|tr|td|th|pre|code|blockquote)\b[^<>]*>|\\(?P<verb>begin|end)\s*\{(?P<env>[^{}\n]*)\}"
    r"|(?m:^ {0,3}(?P<fence>`{3,}|~{3,}))|(?m:^(?:(?P<wiki>\{\|)|\|\}))", re.I)
#: Elements that a chunk may hold the end or the beginning of only; others may lack a closing tag anywhere.
_LONG = {"ul", "ol", "dl", "table", "pre", "blockquote", "fence", "wiki"}


def _elements(text: str) -> list[tuple[int, int]]:
    """Start and end of the structural elements; one that is cut reaches to the end of the text, or from its start."""
    out: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    fence = ""
    for m in _EDGE.finditer(text):
        if fence and not (m["fence"] or "").startswith(fence):
            continue
        if m["fence"]:
            name, opens = "fence", not fence
            fence = m["fence"] if opens else ""
        elif m["tag"]:
            name, opens = m["tag"].lower(), not m["shut"]
        elif m["verb"]:
            name, opens = "\\" + m["env"], m["verb"].lower() == "begin"
        else:
            name, opens = "wiki", bool(m["wiki"])
        if opens:
            opened.append((name, m.start()))
            continue
        at = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name), None)
        if at is not None:
            out.append((opened[at][1], m.end()))
            del opened[at:]
        elif name in _LONG or name[0] == "\\":
            out.append((0, m.end()))
    return out + [(start, len(text)) for name, start in opened if name in _LONG or name[0] == "\\"]


def _widened(text: str, tokens: list[tuple[int, int, str]], start: int, end: int) -> tuple[int, int]:
    """The region out to the ends of its lines or blocks, the structure that touches it, and whole elements."""
    tags = [(a, b) for a, b, k in tokens if text[a : a + 1] == "<" and k != "word" and not _INLINE.match(text, a)]
    whole = _elements(text)
    around = [t for t in tokens if t[2] != "word" and t[0] < t[1]]
    while True:
        was = start, end
        start = max([0, text.rfind("\n", 0, start) + 1, *[b for _, b in tags if b <= start]])
        stop = text.find("\n", end)
        end = min([len(text) if stop < 0 else stop, *[a for a, _ in tags if a >= end]])
        for a, b, k in reversed(around):
            if b <= start and k == "structure" and not text[b:start].strip():
                start = a
        for a, b, k in around:
            if a >= end and k == "structure" and not text[end:a].strip():
                end = b
        for a, b in whole:
            if a < end and b > start:
                start, end = min(a, start), max(b, end)
        if (start, end) == was:
            return start, end


def content(text: str, weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the content region; the whole text where nothing scores."""
    tokens = _tokens(text)
    a, b = best_run([weights[k] for _, _, k in tokens])
    if a == b or (a == 0 and b == len(tokens)):
        return 0, len(text)
    # signs and white space at the outer ends belong to the region when no token lies beyond
    start, end = _widened(text, tokens, 0 if a == 0 else tokens[a][0], len(text) if b == len(tokens) else tokens[b - 1][1])
    return (0 if start <= tokens[0][0] else start), (len(text) if end >= tokens[-1][1] else end)


def fit_weights(pages: Iterable[str] = LABELLED) -> dict[str, float]:
    """Scores of tags and marks, with a word at 1 and structure at 0, that put the region nearest to the labels."""
    marked = [(p.replace("«", "").replace("»", ""), p.index("«"), p.index("»") - 1) for p in pages]

    def overlap(w: dict[str, float]) -> float:
        total = 0.0
        for text, a, b in marked:
            x, y = content(text, w)
            total += max(0, min(b, y) - max(a, x)) / (max(b, y) - min(a, x))
        return total

    options = [{"word": 1.0, "structure": 0.0, "tag": -t / 4, "mark": -m / 8} for t in range(1, 25) for m in range(1, 9)]
    return max(options, key=overlap)


WEIGHTS = fit_weights()

_CODE = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)")
_MATH = re.compile(r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|math|displaymath)\*?\}.*?\\end\{\1\*?\}|(?<![A-Za-z0-9_\\$])\$(?=[^\s$])(?=[^$\n]*[\\^_=+{}()])[^$\n]*[^\s$\\]\$(?![A-Za-z0-9_$])")
#: Under the literals of which a text must have one: what is replaced, and by what.
_STEPS: list[tuple[tuple[str, ...], re.Pattern[str], str]] = [(x, re.compile(a, f), b) for x, a, f, b in (
    (("<!--","<",), r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I, ""),
    (("<h","<H",), r"<h([1-6])\b[^>]*>\s*(.*?)\s*</h\1\s*>", re.S | re.I, r"\n# \2\n"),
    (("<li","<LI",), r"\s*<li\b[^>]*>\s*", re.I, "\n- "),
    (("<td","<th","<TD","<TH",), r"\s*</(?:td|th)>\s*<(?:td|th)\b[^>]*>\s*", re.I, "\t"),
    (("<",), r"<(?:br|hr)\b[^>]*>|</?(?:p|div|section|article|ul|ol|table|tr|blockquote)\b[^>]*>", re.I, "\n"),
    (("<",), rf"</?(?:{'|'.join(ELEMENTS)}|ref|nowiki|gallery)\b[^<>]*>|<!doctype[^<>]*>", re.I, ""),
    (("\\",), r"\\(?:chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", 0, r"\n# \1\n"),
    (("\\item",), r"\\item\b[ \t]*", 0, "- "),
    (("\\",), r"~?\\(?:cite|ref|label|pageref|eqref|bibliography|usepackage|documentclass)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}", 0, ""),
    (("\\footnote",), r"\\footnote\{([^{}]*)\}", 0, r" (\1)"),
    (("\\",), r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", 0, ""),
    (("\\",), r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}", 0, r"\1"),
    (("==",), r"^={2,6}[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$", re.M, r"# \1"),
    (("[[",), r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", 0, r"\1"),
    (("{","|","__",), r"\{\{[^{}\n]+\}\}|^\{\|.*$|^\|[}-][ \t]*$|__(?:TOC|NOTOC|FORCETOC)__", re.M, ""),
    (("[http",), r"\[https?://[^\s\]]+ ([^\]\n]+)\]", 0, r"\1"),
    (("''",), r"'{2,5}(?=[^\s'])([^\n]*?)'{2,5}", 0, r"\1"),
    (("---","===",), r"^([^\n|>{<\\]*\w[^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$", re.M, r"# \1"),
    (("-","*","_",), r"^ {0,3}(?:-(?:[ \t]*-){2,}|\*(?:[ \t]*\*){2,}|_(?:[ \t]*_){2,})[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?(?:[ \t]*\|[ \t]*:?-{2,}:?)*[ \t]*\|?[ \t]*$", re.M, ""),
    (("#",), r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*$", re.M, r"# \1"),
    ((">",), r"^ {0,3}(?:>[ \t]?)+", re.M, ""),
    (("-","*","+","•",), r"^([ \t]*)[-*+•][ \t]+(?:\[[ xX]\][ \t]+)?", re.M, r"\1- "),
    (("|",), r"^[ \t]*\|[ \t]*(.*?)[ \t]*\|?[ \t]*$", re.M, r"\1"),
    (("](",), r"!?\[([^\]\n]*)\]\([^()\n]*\)", 0, r"\1"),
    (("]:","[^",), r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$|\[\^[^\]\s]+\]", re.M, ""),
    (("][",), r"(?<![A-Za-z0-9_\]])\[([^\]\[\n]+)\]\[[^\]\[\n]*\]", 0, r"\1"),
    (("**","__","~~",), r"\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*|(?<![A-Za-z0-9_])__(?=[^\s_])([^\n]*?[^\s_])__(?![A-Za-z0-9_])|~~(?=[^\s~])([^~\n]*[^\s~])~~", 0, r"\1\2\3"),
    (("*",), r"(?<![A-Za-z0-9_*])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![A-Za-z0-9_*])", 0, r"\1"),
    (("`",), r"`([^`\n]+)`", 0, r"\1"),
    (("|",), r"[ \t]*(?:\|\||(?<=\S) \| )[ \t]*", 0, "\t"),
)]


def plain(text: str) -> str:
    """``text`` without markup; headings, list items, code blocks and formulas keep their form."""
    if not _SIGNS.search(text):
        return text.strip()
    kept: list[str] = []

    def keep(piece: str) -> str:
        kept.append(piece)
        return f"\ue000{len(kept) - 1}\ue001"

    text = text.replace("\ue000", "").replace("\ue001", "")
    if "```" in text or "~~~" in text:
        text = _CODE.sub(lambda m: keep("```\n" + m[2].rstrip("\n") + "\n```"), text)
    if "<" in text:
        text = re.sub(r"(?is)<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", lambda m: "\n\n" + keep("```\n" + html.unescape(re.sub(r"<[^<>]+>", "", m[1])).strip("\n") + "\n```") + "\n", text)
    if "$" in text or "\\" in text:
        text = _MATH.sub(lambda m: keep(m[0]), text)
    for held, step, by in _STEPS:
        if any(x in text for x in held):
            text = step.sub(by, text)
    if "&" in text:
        text = html.unescape(text).replace("\xa0", " ")
    if kept:
        text = re.sub(r"\ue000(\d+)\ue001", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


def cleaned(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``id, markup, content_start, content_end, clean``: one row a row of ``rows``.

    ``markup`` lists the kinds a text holds. A null text gives a null ``clean``
    and no kinds, an empty one is empty; whole texts are read, however long;
    repeated rows give repeated results.
    """

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("id", "markup", "content_start", "content_end", "clean")}
        for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
            kinds: list[str] = []
            start, end, clean = None, None, None
            if t is not None:
                kinds = [k for k in KINDS if any(s[2] == k for s in spans(t))]
                start, end = content(t, WEIGHTS) if kinds else (0, len(t))
                clean = plain(t[start:end])
            for k, v in zip(out, (i, kinds, start, end, clean), strict=True):
                out[k].append(v)
        return out

    source = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    return map_columns(source, f, "id bigint, markup array<string>, content_start int, content_end int, clean string")

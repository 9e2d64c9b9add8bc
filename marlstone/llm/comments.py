"""Natural language hidden inside code.

Comments and string literals are cut out of source text, adjacent line comments
as one span. Spans are reduced to distinct ones by a 128-bit hash, each distinct
span is classified once, sentence by sentence, and the labels are joined back to
give every file's shares of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns

LANGUAGES = "en de fr es ru ko zh ja".split()
WORDS, SIGNS = 5, 8

_LINE = r"(?P<line>//[^\n]*)"
_BLOCK = r"(?P<block>/\*(?s:.*?)(?:\*/|\Z))"
_C = rf"{_LINE}|{_BLOCK}"
LEXERS = {
    "py": re.compile(r'''(?P<line>\#[^\n]*)|(?P<raw>[bB]?[rR][bB]?(?:"""(?s:.*?)(?:"""|\Z)|\'\'\'(?s:.*?)(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))'''
                     r'''|(?P<text>"""(?:\\(?s:.)|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\(?s:.)|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')'''),
    "rs": re.compile(rf'''{_C}|(?P<raw>b?r(?P<h>\#*)"(?s:.*?)"(?P=h))|(?P<text>"(?:\\(?s:.)|[^"\\])*")|'(?:\\[^']*|[^'\\\n])\''''),
    "go": re.compile(rf'''{_C}|(?P<raw>`[^`]*`)|(?P<text>"(?:\\.|[^"\\\n])*")|'(?:\\[^']*|[^'\\\n])\''''),
    "js": re.compile(rf'''{_C}|(?P<text>"(?:\\(?s:.)|[^"\\\n])*"|'(?:\\(?s:.)|[^'\\\n])*'|`(?:\\(?s:.)|[^`\\])*`)'''),
}
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([0-7]{3})|(?s:(.)))")
#: What a letter after a backslash stands for.
_NAMED = {"n": "\n", "t": "\t", "r": "\n", "b": " ", "f": " ", "v": " ", "0": " ", "a": " ", "\n": ""}


def _escaped(m: re.Match[str]) -> str:
    for k in (1, 2, 3, 4):
        if m[k]:
            n = int(m[k], 16)
            return chr(n) if n < 0x110000 else " "
    return chr(int(m[5], 8)) if m[5] else _NAMED.get(m[6], m[6])


def decoded(text: str) -> str:
    """Escapes as what they stand for; surrogate pairs as one character."""
    if "\\" not in text:
        return text
    return _ESCAPE.sub(_escaped, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_BORDER = re.compile(r"^[ \t]*(?:\*(?!/)|//+[!/]?|#+!?|--)?[ \t]?", re.M)


def spans(code: str, family: str) -> Iterator[tuple[str, str, int]]:
    """``(kind, text, bytes)`` of comments and string literals, in order."""
    run: list[str] = []
    run_end = run_bytes = 0
    if family != "py" and "*/" in code:
        close, opened = code.find("*/"), code.find("/*")
        if opened < 0 or opened > close:  # the comment began before this piece
            yield "comment", _BORDER.sub("", code[:close]), len(code[:close].encode())
            code = code[close + 2 :]
    for m in LEXERS[family].finditer(code):
        kind, piece = m.lastgroup, m[0]
        if kind == "h":
            kind = "raw"
        if kind == "line":
            between = code[run_end : m.start()]
            if run and between.strip() == "" and between.count("\n") == 1:
                run.append(piece)
            else:
                if run:
                    yield "comment", "\n".join(run), run_bytes
                run, run_bytes = [piece], 0
            run[-1] = _BORDER.sub("", piece, count=1)
            run_bytes += len(piece.encode("utf-8", "surrogatepass"))
            run_end = m.end()
            continue
        if kind is None:
            continue
        if run:
            yield "comment", "\n".join(run), run_bytes
            run, run_bytes = [], 0
        size = len(piece.encode("utf-8", "surrogatepass"))
        if kind == "block":
            inner = piece[2:-2] if piece.endswith("*/") and len(piece) >= 4 else piece[2:]
            yield "comment", _BORDER.sub("", inner.lstrip("*!")), size
        else:
            body = piece.lstrip("bBrR#") if kind == "raw" else piece
            quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
            inner = body.rstrip("#") if kind == "raw" else body
            inner = inner[len(quote) : len(inner) - len(quote) if inner.endswith(quote) and len(inner) >= 2 * len(quote) else None]
            yield "string", inner if kind == "raw" else decoded(inner), size
    if run:
        yield "comment", "\n".join(run), run_bytes


#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": """the a an and or if is are was were be been being it its this that these those not no nor neither for of to in on by with when while
must should would could can may will shall only we you they he she do does did has have had because before after here there nothing every each once
until than then from into at as but what which who how all any some our your their use used so just also still""".split(),
    "de": """der die das den dem des ein eine einen einem einer eines und oder wenn ist sind war wird werden wurde nicht kein keine für von zu im in
auf mit nach vor bis noch nur schon sonst muss darf kann soll man wir sie er es ihn ihm sich dann weil dass als auch aber hier diese dieser dieses
durch um bei aus ob zuerst alle anderen danach zurück""".split(),
    "fr": """le la les un une des du de et ou si est sont était été être ne pas ce cette ces il elle on nous vous ils dans sur avec pour par que qui
quand avant après parce ici rien au aux en se sa son ses leur plus seulement tout toutes tous doit peut déjà encore aussi sinon n'est c'est l'ancien
où mais afin comme juste""".split(),
    "es": """el la los las un una unos unas y o si es son fue era ser está están no ni este esta estos estas se su sus lo le en con para por que quien
cuando antes después porque aquí nada al del de más solo solamente todo toda todas todos debe puede ya también sino pero hay como mientras hasta
todavía otra otro""".split(),
}
_OWNER: dict[str, tuple[str, ...]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _OWNER[_w] = (*_OWNER.get(_w, ()), _lang)

_WORD = re.compile(r"[^\W\d_]+(?:['’_-][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n[ \t]*\n")
#: Signs that code has and sentences have not, or hardly.
_CODE = re.compile(r"[;{}=<>\[\]|\\^$&@]|\w\(|\(\)|::|->|\w\.\w+[.(]|:\s*$|^\s*(?:let|const|var|fn|func|def|class|return|import|from|use|pub|if|for|while|switch|match|try|except|else|elif|defer|raise|throw|yield|await|select|insert|update|delete|assert|with|break|continue)\b")
_QUERY = re.compile(r"(?i)^\s*(?:select\b.*\bfrom\b|insert\s+into\b|update\b.*\bset\b|delete\s+from\b|create\s+(?:table|index|view)\b|alter\s+table\b|drop\s+table\b|with\s+\w+\s+as\s*\()")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_KANA = re.compile(r"[\u3040-\u30ff\u31f0-\u31ff]")
_HANGUL = re.compile(r"[\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f]")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")


#: A place to be filled in a template.
_HOLE = re.compile(r"\$?\{\{?\w*\}\}?")


def _latin(found: list[str]) -> str | None:
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    hits = 0
    for w in found:
        owners = _OWNER.get(w, ())
        hits += bool(owners)
        for x in owners:
            score[x] += 1 / len(owners)
        if any(c in "äöüß" for c in w):
            score["de"] += 0.5
        if any(c in "ñ¿¡áíóú" for c in w):
            score["es"] += 0.5
        if any(c in "àâçèêëîïôœùû" for c in w):
            score["fr"] += 0.5
    best = max(score, key=lambda k: score[k])
    return best if hits >= 2 and score[best] >= max(1.0, 0.12 * len(found)) else None


def sentence_language(sentence: str) -> str | None:
    """The language of one sentence; None where it is no sentence of any."""
    han, kana, hangul = (len(x.findall(sentence)) for x in (_HAN, _KANA, _HANGUL))
    if hangul >= SIGNS and hangul >= han + kana:
        return "ko"
    if han + kana >= SIGNS:
        return "ja" if kana * 10 >= han + kana else "zh"
    if _QUERY.match(sentence):
        return None
    found = [w.lower() for w in _WORD.findall(sentence)]
    if len(found) < WORDS:
        return None
    if len(_CYRILLIC.findall(sentence)) * 2 > sum(map(len, found)):
        return "ru"
    if hangul or kana or han:
        found = [w for w in found if w.isascii() or not (_HAN.search(w) or _KANA.search(w) or _HANGUL.search(w))]
    codelike = len(_CODE.findall(sentence)) + sum("_" in w for w in found)
    if codelike and (codelike * 4 >= len(found) or sentence.rstrip()[-1:] in "{};:("):
        return None
    return _latin(found) if len(found) >= WORDS else None


@lru_cache(maxsize=20_000)
def languages(text: str) -> tuple[str, ...]:
    """Languages of the sentences in a span, in the order of LANGUAGES.

    Lines that look like code end the paragraph they stand in.
    """
    found: set[str] = set()
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            joined = " ".join(paragraph)
            own = {lang for s in _END.split(joined) if s and (lang := sentence_language(s))}
            # short sentences in a row ("Code generated by x. Do not edit.") make one together
            found.update(own or filter(None, [sentence_language(joined)]))
            paragraph.clear()

    for line in _HOLE.sub(" ", text).split("\n"):
        line = line.strip()
        if not line or not re.search(r"\w", line):
            close()
            continue
        words = _WORD.findall(line)
        signs = len(_CODE.findall(line))
        if signs * 3 >= max(1, len(words)) or (signs and line[-1] in "{};:("):
            close()
            if not _QUERY.match(line) and (lang := sentence_language(line)):
                found.add(lang)
            continue
        paragraph.append(line)
    close()
    return tuple(x for x in LANGUAGES if x in found)


_MAYBE = re.compile(r"(?:[^\W\d_]+[\W\d_]+){4}[^\W\d_]|[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")


def extracted(code: DataFrame, row_id: str, file_id: str, text: str, ending: str) -> DataFrame:
    """``id, file, kind, h1, h2, bytes, text`` of spans that may hold a sentence, copies
    within a row once with their bytes summed."""

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("id", "file", "kind", "h1", "h2", "bytes", "text")}
        for i, d, t, e in zip(*(b[k].to_pylist() for k in ("id", "file", "text", "ending")), strict=True):
            family = e if e in ("py", "rs", "go") else "js"
            own: dict[tuple[str, str], int] = {}
            for kind, span, size in spans(t, family):
                if len(span) >= SIGNS and _MAYBE.search(span):
                    own[kind, span] = own.get((kind, span), 0) + size
            for (kind, span), size in own.items():
                h = xxhash.xxh3_128_intdigest(span.encode("utf-8", "surrogatepass"))
                for k, v in zip(out, (i, d, kind, h & 0xFFFFFFFFFFFFFFFF, h >> 64, size, span.encode("utf-8", "replace").decode()), strict=True):
                    out[k].append(v)
        for k in ("h1", "h2"):
            out[k] = np.array(out[k], np.uint64).view(np.int64)
        return out

    source = code.select(F.col(row_id).alias("id"), F.col(file_id).alias("file"), F.col(text).alias("text"), F.col(ending).alias("ending"))
    return map_columns(
        source.where(F.col("text").isNotNull() & F.col("id").isNotNull()), f,
        "id bigint, file bigint, kind string, h1 bigint, h2 bigint, bytes bigint, text string",
    )


def labelled(spans_: DataFrame) -> DataFrame:
    """``h1, h2, lang``: each distinct span once for each language that it holds."""

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {"h1": [], "h2": [], "lang": []}
        for h1, h2, t in zip(*(b[k].to_pylist() for k in ("h1", "h2", "text")), strict=True):
            for lang in languages(t):
                out["h1"].append(h1)
                out["h2"].append(h2)
                out["lang"].append(lang)
        return out

    once = spans_.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    return map_columns(once, f, "h1 bigint, h2 bigint, lang string")


def hidden_language(code: DataFrame, row_id: str, file_id: str, text: str, ending: str) -> DataFrame:
    """``id, file, kind, lang, bytes``: what each row of source holds by kind and language.

    A span in two languages counts for both. Null ids and texts take no part,
    an empty text holds nothing, repeated rows (same id) count once; whole texts
    are read, however long.
    """
    found = extracted(code, row_id, file_id, text, ending)
    # rows per hash may be very many (licence notices): the labels are one row a hash, and adaptive execution splits the rest
    labels = labelled(found)
    return (
        found.select("id", "file", "kind", "h1", "h2", "bytes").join(labels, ["h1", "h2"])
        .dropDuplicates(["id", "kind", "h1", "h2", "lang"])
        .groupBy("id", "file", "kind", "lang").agg(F.sum("bytes").alias("bytes"))
    )


def shares(held: DataFrame, code: DataFrame, row_id: str, file_id: str, text: str) -> DataFrame:
    """``file, lang, bytes, share``: of each file's bytes, those in spans of a language."""
    sizes = code.where(F.col(row_id).isNotNull()).select(row_id, F.col(file_id).alias("file"), F.octet_length(text).cast("bigint").alias("n"))
    total = sizes.dropDuplicates([row_id]).groupBy("file").agg(F.sum("n").alias("total"))
    parts = held.groupBy("file", "lang").agg(F.sum("bytes").alias("bytes"))
    return parts.join(total, "file").select("file", "lang", "bytes", F.try_divide("bytes", "total").alias("share"))

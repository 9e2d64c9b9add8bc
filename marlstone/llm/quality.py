"""Per-document text quality: statistics, and a mixture that tells prose from the rest.

Each text becomes a row of statistics. Over all rows, standardised, a Gaussian
mixture is fitted by expectation-maximisation; every step is one pass that sends
only sums per component. Components start at, and get their meaning from,
inspected examples of prose, lists, tables and junk.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns
from marlstone.llm.comments import FUNCTION_WORDS
from marlstone.session import written

CLASSES = ("prose", "list", "table", "junk")
STATS = ("running_share", "common_share", "words_per_line", "mean_word_length", "symbol_ratio", "digit_ratio", "ending_share", "marked_share")

#: Frequent function words of Russian; those of four other languages are shared.
RUSSIAN = """и в не на с что как это по но он она они его её их к у из за от для до о если или так же бы был была было были быть только уже ещё пока
потом когда где после перед здесь нет ничего можно нужно должен всё все этот эта эти того чтобы сам свой при прежде чем между ни""".split()
_COMMON = frozenset(RUSSIAN).union(*FUNCTION_WORDS.values())
#: Endings of Korean words in sentences; signs of Chinese and Japanese grammar.
_KOREAN = re.compile(r"(?:니다|에서|에는|까지|으면|없으면|지만|하고|도록|[을를은는만])$")
_CHINESE = re.compile("[的了在是不会把被还没有请如果那么就已经这个之前因为可能但下一次它所以其余由并和每最多我们]")
_JAPANESE = re.compile("[はがをにのでともますかられ]")
_HAN_KANA = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_HIRAGANA = re.compile(r"[\u3040-\u309f]")
_HANGUL = re.compile(r"[\uac00-\ud7a3]")

_WORD = re.compile(r"\w+(?:['’]\w+)*")
_MARKED = re.compile(r"^\s*(?:[-*+•·‣▪]|\d+(?:\.\d+)*[.)]|\d+(?:\.\d+)+)\s+\S|^[^|]*\|[^|]*\||\t.*\t|^[^;]*;[^;]*;[^;]*;|\.{4,}|\S {4,}\S|^\d{1,2}:\d\d:\d\d")
_SYMBOL = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_ENDING = re.compile(r"[.!?。！？…:;]['\"»”)\]]*$")
_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?</\1\s*>|</?[A-Za-z][^<>]*>", re.S | re.I)
_ITEM = re.compile(r"<li\b[^>]*>", re.I)
_CELL = re.compile(r"</t[dh]>\s*<t[dh]\b[^>]*>", re.I)
_GAP = re.compile(r" *\x01[ \x01]*")
_TEX = re.compile(r"~?\\[A-Za-z]+\*?|[{}]")


def unmarked(text: str) -> str:
    """Tags, entities and commands off; list items and cells keep a sign of what they are."""
    if "<" in text:
        text = _GAP.sub(" ", _TAGS.sub("\x01", _CELL.sub("\t", _ITEM.sub("\x01- ", text))))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _TEX.sub(" ", text)
    return text


def _grammar(line: str) -> tuple[float, float]:
    """Signs of grammar in a line, and the units that could be such."""
    east = _HAN_KANA.findall(line)
    if len(east) * 3 > len(line):
        found = len((_JAPANESE if _HIRAGANA.search(line) else _CHINESE).findall(line))
        return found * 0.8, len(east)
    words = _WORD.findall(line.lower())
    if _HANGUL.search(line):
        return sum((w in _COMMON) or bool(_KOREAN.search(w)) for w in words), len(words)
    return sum(w in _COMMON for w in words), len(words)


#: Of a line and its neighbours, so much must be grammar for the line to be of running text.
RUNNING = 0.15


def statistics(text: str) -> tuple[int, tuple[float, ...]]:
    """``n_words`` and STATS of one text; all zero where nothing is left without markup."""
    lines = [x.strip() for x in unmarked(text).split("\n")]
    lines = [x for x in lines if x and _WORD.search(x)]
    if not lines:
        return 0, (0.0,) * len(STATS)
    marked = [bool(_MARKED.search(x)) for x in lines]
    seen = [_grammar(x) for x in lines]
    weight = [len(x) - x.count(" ") for x in lines]
    running = 0
    for i, (hit, unit) in enumerate(seen):
        if marked[i]:
            # a list item or row may be a sentence all the same
            running += weight[i] * (hit >= 2 and unit >= 5 and hit >= 2 * RUNNING * unit)
            continue
        for j in (i - 1, i + 1):
            if 0 <= j < len(lines) and not marked[j]:
                hit, unit = hit + seen[j][0], unit + seen[j][1]
        running += weight[i] * (unit >= 3 and hit >= RUNNING * unit and (seen[i][0] > 0 or seen[i][1] <= 8))
    whole = "\n".join(lines)
    words = _WORD.findall(whole)
    total = sum(weight)
    stats = (
        running / total,
        sum(h for h, _ in seen) / max(1.0, sum(u for _, u in seen)),
        len(words) / len(lines),
        sum(map(len, words)) / len(words),
        len(_SYMBOL.findall(whole)) / total,
        len(_DIGIT.findall(whole)) / total,
        sum(bool(_ENDING.search(x)) for x in lines) / len(lines),
        sum(marked) / len(lines),
    )
    return len(words), stats


_PROSE = "The reader keeps its place in the file when it is opened again, and nobody has to look for it.\nIf the page was removed, then the next one is shown.\n"
#: Inspected examples, with what they are.
EXAMPLES: tuple[tuple[str, str], ...] = (
    ("prose", _PROSE * 3),
    ("prose", "the reader keeps its place in the file when it is opened\nagain and nobody has to look for it if the page was\nremoved then the next one is shown\n" * 3),
    ("prose", "如果页面已经不存在，那么下一个页面就会打开。在新的文件关闭之前，这个读者会先保留它的位置。\n" * 3),
    ("prose", "ページがすでに無い場合は、次のページを開きます。新しいファイルを閉じる前に、この読者は位置を保持します。\n" * 3),
    ("prose", "Если страница была удалена, то следующая откроется сама. После перезапуска файл пока не готов, и его можно проверить только потом.\n" * 3),
    ("prose", "만약 쪽이 없으면 다음 쪽을 다시 엽니다. 이 파일은 최대 세 개의 쪽을 한 번에 보여 줍니다.\n" * 3),
    ("list", "".join(f"- {a} {b}\n" for a, b in zip("apple stone river lamp paper cloud".split(), "box_a shelf roof_b hall yard gate".split(), strict=True)) * 3),
    ("list", "".join(f"{n}. open {a}\n" for n, a in enumerate("door lamp page book cart wheel".split(), 1)) * 3),
    ("list", "Paper roof | Stone hall | River gate | Lamp yard\nCloud box | Apple shelf | Cart wheel | Book door\n" * 4),
    ("list", "paper stone river lamp cloud apple cart book door wheel roof hall gate yard shelf box page lamp river open close small green\n" * 3),
    ("table", "".join(f"{a}\t{n * 37}\t{n / 7:.2f}\tyes\n" for n, a in enumerate("door lamp page book cart wheel".split(), 3)) * 3),
    ("table", "".join(f"{a};{n * 3711};{n / 7:.2f};{n * 97}\n" for n, a in enumerate("door lamp page book cart wheel".split(), 3)) * 3),
    ("table", "".join(f"| {a} | {n * 3711} | {n / 7:.2f} |\n" for n, a in enumerate("door lamp page book cart wheel".split(), 3)) * 3),
    ("table", "".join(f"10:0{n}:11.20{n} [{a}-{n}] size={n * 811} place=0x{n * 99991:x}\n" for n, a in enumerate("door lamp page book cart wheel".split(), 3)) * 3),
    ("junk", "Qb7xTf0aZk3LmPq9Rw2sVd8uYhJ4nCe6GiKo1XtB5rDvEyNzWjHgAlSfUpMkOcIx+/q7\nZt2PbLw8KdRn5XfQs0VjHyMa3TgCu9EoIi6WkNmBx4FvSlGhJeYp1DrOzUAq/Tc7Kb+w\n" * 4),
    ("junk", "Ã¶Ð½ Â¿ÃµÑ Ð°Ã¢ Å¡Â°o Ãs ÐµtÂ¡ ÄÃ¼n Ñ¾a Ã€Âr\nâ€™Ã¤Ð¶ Ã±eÂ· ÑƒÃ³ ÅžÂ´i\n" * 5),
    ("junk", "x,;b %s 5=l ^o+ |g a:;v 0h. 1b% =c ;t 5n |o ^d+ m;. u=l ,h g0\nb;e 5^ |s +n 1: %a .t o= ;r 0l\n" * 4),
)


def example_statistics() -> tuple[list[str], np.ndarray]:
    return [k for k, _ in EXAMPLES], np.array([statistics(t)[1] for _, t in EXAMPLES])


def document_statistics(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, n_chars, n_words`` and STATS per document with text; empty and null texts give no row.

    Whole texts are read; a repeated row (same id) counts once.
    """
    names = ("id", "n_chars", "n_words", *STATS)

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in names}
        for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
            n, stats = statistics(t)
            for k, v in zip(names, (i, len(t), n, *stats), strict=True):
                out[k].append(v)
        return out

    source = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    return map_columns(source, f, "id bigint, n_chars bigint, n_words bigint, " + ", ".join(f"{k} double" for k in STATS)).dropDuplicates(["id"])


class Mixture:
    """A Gaussian mixture with variances per statistic."""

    #: Least variance, in units of the statistic's variance over all documents.
    FLOOR = 0.01

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: np.ndarray):
        self.centre, self.scale, self.means = centre, scale, means
        self.weights, self.variances = np.full(len(means), 1 / len(means)), np.full(means.shape, 0.25)

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; ``x`` as measured."""
        z = (x - self.centre) / self.scale
        log = np.stack([
            np.log(max(w, 1e-300)) - 0.5 * (((z - m) ** 2 / v) + np.log(v)).sum(1) for w, m, v in zip(self.weights, self.means, self.variances, strict=True)
        ], axis=1)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def step(self, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> float:
        """New parameters from sums of responsibilities, of z and of z squared; how far the means moved."""
        alive = n > 1e-6
        means = np.where(alive[:, None], first / np.maximum(n, 1e-6)[:, None], self.means)
        spread = np.where(alive[:, None], second / np.maximum(n, 1e-6)[:, None] - means**2, self.variances)
        moved = float(np.abs(means - self.means).max())
        self.weights, self.means, self.variances = n / n.sum(), means, np.maximum(spread, self.FLOOR)
        return moved


def _rows(b: dict[str, pa.Array]) -> np.ndarray:
    return np.stack([b[k].to_numpy(zero_copy_only=False) for k in STATS], axis=1)


def fit(stats: DataFrame, steps: int = 200, tolerance: float = 0.003) -> tuple[Mixture, list[str]]:
    """The mixture over all rows of ``stats`` (a written table), and its components' classes.

    Passes go on until no mean moves by more than ``tolerance`` deviations; an
    error after ``steps`` of them.
    """
    labels, examples = example_statistics()
    both = stats.agg(*[f(k).alias(f"{n}_{k}") for k in STATS for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()
    centre = np.array([both[f"mean_{k}"] or 0.0 for k in STATS])
    scale = np.array([max(both[f"dev_{k}"] or 0.0, 1e-3) for k in STATS])
    mixture = Mixture(centre, scale, (examples - centre) / scale)
    k, d = mixture.means.shape
    moved = 0.0 if both["mean_running_share"] is None else 1.0
    for _ in range(steps):
        if moved < tolerance:
            break

        def f(b: dict[str, pa.Array], mixture: Mixture = mixture) -> dict[str, object]:
            x = _rows(b)
            p, z = mixture.responsibilities(x), (x - mixture.centre) / mixture.scale
            sums = np.concatenate([p.sum(0)[:, None], p.T @ z, p.T @ z**2], axis=1).ravel()
            return {"slot": np.arange(len(sums)), "value": sums}

        sums = np.zeros(k * (1 + 2 * d))
        for row in map_columns(stats.select(*STATS), f, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
            sums[row["slot"]] = row["value"]
        sums = sums.reshape(k, 1 + 2 * d)
        moved = mixture.step(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :])
    if moved >= tolerance:
        raise RuntimeError(f"the mixture still moves after {steps} passes")
    # a component is what the examples in it are; one that holds none is what the nearest example is
    p = mixture.responsibilities(examples)
    named = []
    for j in range(k):
        votes = {c: p[[i for i, x in enumerate(labels) if x == c], j].sum() for c in CLASSES}
        near = labels[int(np.argmin((((examples - centre) / scale - mixture.means[j]) ** 2).sum(1)))]
        best = max(votes, key=lambda c: votes[c])
        named.append(best if votes[best] > 0.5 else near)
    return mixture, named


def classified(stats: DataFrame, mixture: Mixture, named: list[str]) -> DataFrame:
    """``stats`` with ``kind`` and the probability of each class."""
    columns = ["id", "n_chars", "n_words", *STATS]

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        p = mixture.responsibilities(_rows(b))
        of = np.stack([p[:, [j for j, x in enumerate(named) if x == c]].sum(1) for c in CLASSES], axis=1)
        return {**{k: b[k] for k in columns}, "kind": [CLASSES[j] for j in of.argmax(1)], **{f"p_{c}": of[:, j] for j, c in enumerate(CLASSES)}}

    kinds = "id bigint, n_chars bigint, n_words bigint, " + ", ".join(f"{k} double" for k in STATS)
    return map_columns(stats.select(*columns), f, kinds + ", kind string, " + ", ".join(f"p_{c} double" for c in CLASSES))


def judged(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Statistics, ``kind`` and class probabilities of every document with text.

    An empty table gives no rows. Texts that hold nothing but markup have all
    statistics at zero and ``running_share`` 0.
    """
    stats = written(document_statistics(documents, doc_id, text), "statistics")
    return classified(stats, *fit(stats))


def not_prose(rows: DataFrame) -> DataFrame:
    """Documents that the mixture holds for lists, tables or junk."""
    return rows.where(F.col("kind") != "prose")

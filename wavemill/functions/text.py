"""Text functions.  Normalisation needs NFKC, which Spark lacks, so it is an Arrow UDF; the rest is built in where it can be."""

from __future__ import annotations

import difflib
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose presence marks an instruction transcript as reliable.
INSTRUCTION_WORDS = [
    "什么", "调到", "吃什", "模式", "打开", "空调", "播放", "二十", "风速", "到二",
    "关闭", "开启", "度调", "温度", "开到", "速调", "把温", "食物", "适合", "灯光",
    "关掉", "哪些", "百分", "分之", "到最", "些食", "合吃", "到百", "窗帘", "一点",
    "我要", "我想", "想听", "客厅", "防直", "直吹", "到十", "吃哪", "音乐", "CO",
]


class _Kept(dict):
    """A translation table filled as characters are met: punctuation (all Unicode ``P*``) and ASCII white space go."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c).startswith("P") or c in " \t\n\r\x0b\x0c" else code
        return self[code]


_KEPT = _Kept()


def normalise(text: str | None) -> str:
    """NFKC, lower case, trimmed, without punctuation (all Unicode ``P*``) and ASCII white space."""
    return unicodedata.normalize("NFKC", text or "").lower().strip().translate(_KEPT)


def arrow_udf(returns: str, function, *columns: Column | str) -> Column:
    """An Arrow UDF over Python values; made when called, as importing this module in a worker must not need a session."""

    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series)], dtype=object)

    return run(*columns)


def normalize_plain(c: Column) -> Column:
    """``normalise`` for ASCII texts, without leaving the JVM."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\p{P}\s]|^[\x1c-\x1f\s]+|[\x1c-\x1f\s]+$", "")


def normalize_text(c: Column | str) -> Column:
    """``normalise``; Python gets a text only where it has more than ASCII."""
    c = F.col(c) if isinstance(c, str) else c
    plain = ~F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.when(plain, normalize_plain(c)).otherwise(arrow_udf("string", normalise, F.when(~plain, c)))


strip_punctuation = normalize_text


def edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(hypothesis, reference)


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per reference character of normalised texts; with an empty reference 0 if the other is empty too, else 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(edits(reference, hypothesis) / n)


def outcome_error(label: Column, content: Column) -> Column:
    """Per-row rate of labelled rows: null without a label; both empty 0, one empty 1."""
    both = (F.length(label) == 0) & (F.length(content) == 0)
    one = (F.length(label) == 0) | (F.length(content) == 0)
    return F.when(label.isNull(), None).when(both, 0.0).when(one, 1.0).otherwise(error_rate(label, content))


def text_similarity(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - error_rate(b, a)))


def has_letters(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def language_order(c: Column) -> Column:
    return F.when(has_letters(c), F.array(F.lit("en"), F.lit("zh"))).otherwise(F.array(F.lit("zh")))


def instruction_reliable(c: Column, words: list[str] | None = None) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words or INSTRUCTION_WORDS]), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


def phonetic(text: str, syllables: Callable[[str], str] | None = None) -> str:
    """Syllables joined if the text has a CJK character and a table is given, else lower case without spaces."""
    if not text.isascii() and any("一" <= c <= "鿿" for c in text):
        return "".join(map(syllables, text)) if syllables else text.lower()
    return text.lower().replace(" ", "")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


class _Parts:
    """How much of a keyword any part of what was heard can match, for many texts at once.

    ``longest`` goes from parts of one character to longer ones: for each place
    where a part can begin it has the length of the longest common subsequence
    with the keyword, in bits of 64-bit words that are updated for all places
    together (a keyword of more than 64 characters takes several words).
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        keys, texts = ([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in side] for side in zip(*pairs))
        self.size = np.array([len(k) for k in keys])
        lens = np.array([len(h) for h in texts])
        self.begin = np.cumsum(lens) - lens
        self.row = np.repeat(np.arange(len(pairs)), lens)
        self.end = np.repeat(self.begin + lens, lens)
        heard = np.concatenate(texts)
        words = -(-int(self.size.max()) // 64)
        self.equal = np.zeros((words, len(heard)), np.uint64)  # which characters of the keyword stand at a place
        for j in range(int(self.size.max())):
            at = np.array([k[j] if j < len(k) else 0xFFFFFFFF for k in keys], np.uint32)
            self.equal[j // 64] |= (heard == at[self.row]).astype(np.uint64) << np.uint64(j % 64)
        self.state = np.full_like(self.equal, 0xFFFFFFFFFFFFFFFF)
        self.length, self.at = 0, np.arange(len(heard))

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of parts that are one character longer than those before, and their common subsequences' lengths."""
        self.length += 1
        inside = self.at + self.length <= self.end[self.at]
        if not inside.all():
            self.at, self.state = self.at[inside], self.state[:, inside]
        carry = np.zeros(len(self.at), np.uint64)
        common = np.zeros(len(self.at), np.int64)
        for w, v in enumerate(self.state):
            u = v & self.equal[w, self.at + self.length - 1]
            one = v + u
            total = one + carry
            carry = ((one < v) | (total < one)).astype(np.uint64)
            self.state[w] = total | (v & ~u)
            common += np.bitwise_count(~self.state[w])
        return self.at, common

    def keep(self, open_rows: np.ndarray) -> None:
        """Go on with the texts that are marked only."""
        some = open_rows[self.row[self.at]]
        if not some.all():
            self.at, self.state = self.at[some], self.state[:, some]


def wakewords(pairs: list[tuple[str | None, str | None]], syllables: Callable[[str], str] | None = None) -> list[float]:
    """For each keyword and what was heard: the best of the whole-text matching ratio, the edit similarity and the ratio with any part of what was heard.

    A part's ratio is at most that of its longest common subsequence with the
    keyword, which is found for all parts of all texts together; only the parts
    whose bound is above the best ratio so far are matched.
    """
    out = [0.0] * len(pairs)
    spoken = [(i, phonetic(k, syllables), phonetic(h, syllables)) for i, (k, h) in enumerate(pairs) if k and h]
    spoken = [x for x in spoken if x[1] and x[2]]
    for i, k, h in spoken:
        if k in h:
            out[i] = 1.0
    group: list[tuple[int, str, str]] = []
    places = 0
    for x in (*(x for x in spoken if out[x[0]] < 1), None):
        if group and (x is None or places + len(x[2]) > 200_000):
            for (i, *_), v in zip(group, _best_parts([g[1:] for g in group])):
                out[i] = v
            group, places = [], 0
        if x is not None:
            group.append(x)
            places += len(x[2])
    return out


def _best_parts(pairs: list[tuple[str, str]]) -> list[float]:
    parts, best = _Parts(pairs), np.zeros(len(pairs))
    matchers: dict[tuple[int, str], float] = {}

    def match(row: int, part: str) -> None:
        if (row, part) not in matchers:
            matchers[row, part] = difflib.SequenceMatcher(None, pairs[row][0], part).ratio()
        best[row] = max(best[row], matchers[row, part])

    def match_all(at: np.ndarray, bound: np.ndarray, length: int) -> None:
        for k in np.flatnonzero(bound > best[parts.row[at]]):
            row = int(parts.row[at[k]])
            if bound[k] > best[row]:
                start = int(at[k] - parts.begin[row])
                match(row, pairs[row][1][start : start + length])

    # The best bound among parts that are as long as the keyword comes first: it usually is the best part.
    early = []
    top = int(parts.size.max())
    while len(parts.at) and parts.length < top:
        at, common = parts.longest()
        size = parts.size[parts.row[at]]
        bound = 2 * common / (size + parts.length)
        early.append((parts.length, at, bound))
        same = np.flatnonzero(size == parts.length)
        if len(same):
            order = same[np.lexsort((-bound[same], parts.row[at[same]]))]
            rows = parts.row[at[order]]
            firsts = order[np.concatenate([[True], rows[1:] != rows[:-1]])]
            for k in firsts:
                row = int(parts.row[at[k]])
                start = int(at[k] - parts.begin[row])
                match(row, pairs[row][1][start : start + parts.length])
    for length, at, bound in sorted(early, key=lambda x: -x[0]):
        match_all(at, bound, length)
    while True:
        # A longer part can match the whole keyword at most.
        parts.keep(2 * parts.size / (parts.size + parts.length + 1) > best)
        if not len(parts.at):
            break
        at, common = parts.longest()
        match_all(at, 2 * common / (parts.size[parts.row[at]] + parts.length), parts.length)
    for row, (k, h) in enumerate(pairs):
        if min(len(k), len(h)) / max(len(k), len(h)) > best[row]:  # no more characters than that can be kept
            best[row] = max(best[row], 1 - _distance(k, h) / max(len(k), len(h)))
    return best.tolist()


def wakeword(keyword: str | None, heard: str | None, syllables: Callable[[str], str] | None = None) -> float:
    return wakewords([(keyword, heard)], syllables)[0]


def wakeword_similarity(keyword: Column | str, heard: Column | str, syllables: Callable[[str], str] | None = None) -> Column:
    """``syllables`` gives the sound of a CJK character (a table's lookup); without it characters are compared.  A batch of rows is searched at once."""

    @F.pandas_udf("double")
    def run(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(wakewords([(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(k, h)], syllables), dtype="float64")

    return run(keyword, heard)


def phonetic_key(c: Column | str, syllables: Callable[[str], str] | None = None) -> Column:
    return arrow_udf("string", lambda v: None if pd.isna(v) else phonetic(v, syllables), c)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    return arrow_udf("double", lambda x, y: difflib.SequenceMatcher(None, x or "", y or "").ratio(), a, b)


def rich_text(c: Column) -> Column:
    """Recogniser output without ``<|tag|>`` marks."""
    return F.trim(F.regexp_replace(c, r"<\|[^|>]*\|>", ""))


def preferred_text(normalised: Column, plain: Column) -> Column:
    return F.coalesce(F.nullif(normalised, F.lit("")), plain)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def rooted(root: str, path: Column) -> Column:
    """Path under ``root`` unless it is absolute."""
    p = slashed(path)
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), p))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def suffixed(path: Column, old: str, new: str) -> Column:
    return F.replace(path, F.lit(old), F.lit(new))


def normal_path(path: str) -> str:
    return os.path.normpath(path.replace("\\", "/")).replace("\\", "/")


def normalised_path(path: Column | str) -> Column:
    return arrow_udf("string", lambda v: None if pd.isna(v) else normal_path(v), path)


def four_places(c: Column) -> Column:
    """For sinks only: four decimals from the exact binary value, ties to even, null as empty."""

    return arrow_udf("string", lambda v: "" if pd.isna(v) else f"{v:.4f}", c)

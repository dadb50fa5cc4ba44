"""Text of scanned pages: finding and undoing what scanning did to it.

Three sources of evidence, each counted over the whole corpus first:

* furniture: the skeletons (letters only, with confusable letters made one) of
  what stands in a document's page margins, or opens or closes most of its
  pages; lines with such a skeleton, or with the form of a page number, are
  taken out wherever they stand;
* a lexicon of the words, letters and CJK pairs of documents that are not
  scans;
* a decoder over the de-lined stream of a body: its letters with every blank,
  line end and hyphen at a line end as something that may be there by mistake.
  One dynamic programme chooses where words begin and end, at a cost for each
  blank or line end left out, each boundary put in, each confusion, and each
  word that the lexicon lacks.

Paragraph ends are then chosen by a second dynamic programme over the lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.durable import settle
from quern.session import ship_package

#: Page edges in points from the top: a block with its middle beyond them stands in the margin.
TOP_EDGE, BOTTOM_EDGE = 90.0, 700.0
#: How scanners misread, as misread form and true form.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("ri", "n"), ("nn", "m"),
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("@", "a"), ("†", "t"), ("ſ", "s"), ("ſ", "f"), ("í", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("|", "l"), ("$", "s"), ("€", "e"),
)


def _by_first() -> dict[str, list[tuple[str, str, int]]]:
    """Confusions, also one within what another gives (misread, true, how many), by their first character."""
    found = {(a, b): 1 for a, b in CONFUSIONS}
    for a, b in CONFUSIONS:
        for c, d in CONFUSIONS:
            at = c.find(b)
            while at >= 0:
                whole = c[:at] + a + c[at + len(b) :]
                if whole != d:
                    found.setdefault((whole, d), 2)
                at = c.find(b, at + 1)
    out: dict[str, list[tuple[str, str, int]]] = {}
    for (a, b), n in found.items():
        out.setdefault(a[0], []).append((a, b, n))
    return out


_BY_FIRST = _by_first()
#: CJK characters and what they are misread for.
CJK_CONFUSIONS = {
    "贵": "责", "软": "款", "豋": "登", "很": "限", "末": "未", "夭": "天", "汪": "证", "己": "已", "扳": "板", "囗": "口", "络": "终", "各": "备", "帐": "账", "读": "续", "柜": "拒",
    "佼": "校", "摸": "模", "曰": "日", "人": "入", "入": "人", "间": "问", "问": "间", "责": "贵", "终": "络", "土": "士", "士": "土", "千": "干", "干": "千", "大": "太", "木": "本", "侯": "候", "折": "拆", "拆": "折",
}
#: CJK characters that stand for any unread one.
CJK_UNREAD = frozenset("囗豋夭佼曰")
#: Shares of all words of clean text: a word of the lexicon (so there are 1 / LEAST_SHARE at most, and as many letters and
#: CJK pairs), a word that may be part of a joined run, the same of one or two letters; share of all CJK pairs of one that tells a misreading.
LEAST_SHARE, COMMON_SHARE, SHORT_SHARE, PAIR_SHARE = 1e-6, 3.3e-5, 3.3e-4, 5e-6
#: Cost a letter up to which a long run still counts as read.
_COST_A_LETTER = 0.6
_HYPHENS = "-‐‑­¬"
_WORD = regex.compile(r"\p{L}+(?:[-'’]\p{L}+)*")
_CODE = regex.compile(r"(?<![\p{L}\d])\p{Lu}{1,3}-\d{1,5}\p{Lu}?(?![\p{L}\d])")
_CJKS = regex.compile(r"[一-鿿]+")
_RUN = regex.compile(r"\p{Latin}+")
#: What may part two halves of a word: a hyphen at a line end, a line end, one blank, several.
_GAP = regex.compile(rf"(?P<hyphen>[{_HYPHENS}][^\S\n]*\n[^\S\n]*)|(?P<line>[^\S\n]*\n[^\S\n]*)|(?P<blank>[^\S\n])|(?P<wide>[^\S\n]+)")
_ONE_SIGN = {"\n": "line", " ": "blank", "\t": "blank", "\xa0": "blank", "\u3000": "blank"}
#: What may stand before and after a word, between it and white space.
_LEAD, _TAIL = frozenset("\"'“„«(["), frozenset("\"'”“»).,;:!?…]")
_SPACED_CJK = regex.compile(r"(?<![一-鿿])[一-鿿](?:[ \u3000][一-鿿])+(?![一-鿿])")
_GAP_CJK = regex.compile(r"(?<=[一-鿿])[ \u3000](?=[一-鿿])")
_SIGNS = regex.compile(r"[\W\d]+")
_LINE_END = regex.compile(r"\r\n|\n|\r")
_NO_LETTER = regex.compile(r"[^\p{L}]")
_NOT_PROSE = regex.compile(r"<[^>\n]{1,80}>|&\w+;|https?://\S+|\\\p{L}+|[\w./-]*/[\w./-]*")
_JOINT = regex.compile(r"[-'’]")
_HUMP = regex.compile(r"\p{Ll}\p{Lu}")
_SHORT = regex.compile(r"\p{Lu}{1,3}-?\d*\p{Lu}?")
_BLOT = regex.compile(r"\p{L}[†@•^¬¦·.,;\"][\p{L}\d]|[†@]\p{L}|\p{L}[†@]")
_APOSTROPHE = regex.compile(r"\p{L}['’]\p{L}")
_BLOTS = regex.compile(r"[•^¬¦·.,;\"'’]")
_DIGIT = regex.compile(r"\d")
_ELISION = regex.compile(r"['’]")
_ENGLISH = regex.compile(r"['’](?:s|t|re|ve|ll|d)$")
_CLOSING = regex.compile(r"[.!?。！？:：;；][\"'”’»)\]]*\s*$")
_ONE_END = regex.compile(r"(?<!\n)\n(?!\n)")
_LAST_WORD = regex.compile(rf"(?<word>\p{{Latin}}+)(?<hyphen>[{_HYPHENS}]?)[^\S\n]*$")
_FIRST_WORD = regex.compile(r"[^\S\n]*(?<word>\p{Latin}+)")
_BLANK = regex.compile(r"\n[^\S\n]*\n")
_CHUNK = regex.compile(r"\S+")
_LETTER, _LATIN = regex.compile(r"\p{L}"), regex.compile(r"\p{Latin}")
_PART = regex.compile(r"[^一-鿿\u3000-〿＀-￯/\\<>=&#{}()\[\]]+")
_ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = r"(?=[lIoOSi]*[0-9])[0-9lIoOSi]++"
_PAGE = regex.compile(
    rf"\s*(?:[\[(·•\-–—|. ]*\s*(?:{_NUMBER}|{_ROMAN})\s*[\])·•\-–—|. ]*|(?:p|pp|pg|page|seite|s)\s*\.?\s*{_NUMBER}(?:\s*(?:of|sur|von|de|/)\s*{_NUMBER})?|{_NUMBER}\s*/\s*{_NUMBER}|第\s*{_NUMBER}\s*页(?:\s*[,，/]?\s*共\s*{_NUMBER}\s*页)?)\s*",
    regex.I,
)
_CANON = str.maketrans({"1": "l", "i": "l", "|": "l", "í": "l", "0": "o", "5": "s", "ſ": "s", "f": "s", "9": "g", "@": "a", "†": "t", "c": "e", "b": "h", "q": "g", "6": "h", "8": "h"})
_CJK_CANON = str.maketrans({a: min(a, b) for a, b in CJK_CONFUSIONS.items()})


def is_page_number(line: str) -> bool:
    return bool(line.strip()) and _PAGE.fullmatch(line) is not None


def skeleton(line: str) -> str:
    """What stays of a line when numbers, spaces, signs and confusable letters no longer differ; "" if that is little."""
    words = [w for w in line.split() if not _SIGNS.fullmatch(w) or w in "@†"]
    s = "".join(words).casefold().replace("ﬁ", "fi").replace("ﬂ", "fl")
    for wrong, right in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h")):
        s = s.replace(wrong, right)
    s = _NO_LETTER.sub("", s.translate(_CANON)).translate(_CJK_CANON)
    return s if len(s) >= 3 else ""


def split_lines(text: str) -> list[str]:
    return _LINE_END.split(text)


class Lexicon:
    """Words, letters and CJK pairs of clean text, with their counts."""

    def __init__(self, words: dict[str, int], letters: dict[str, int], pairs: dict[str, int]):
        self.words, self.letters, self.pairs = words, letters, pairs
        sum_letters = sum(letters.values())
        self.known = {c for c, n in letters.items() if n * 200_000 >= sum_letters}
        self._alive: dict[tuple, bool] = {}
        self._memo: dict[tuple[str, bool], tuple[str, ...] | None] = {}
        self.chunks: dict[str, list] = {}
        self.costs: dict[str, float] = {}
        self.order = sorted(words)
        total = sum(words.values())
        self.common, self.common_short = COMMON_SHARE * total, SHORT_SHARE * total
        self.telling = PAIR_SHARE * sum(pairs.values())

    def cohesion(self, a: str, b: str) -> float:
        """How far two CJK characters belong together: 1 if neither stands without the other."""
        n = self.pairs.get(a + b, 0)
        return n / max(1.0, (self.letters.get(a, 0) * self.letters.get(b, 0)) ** 0.5)

    def has(self, word: str) -> bool:
        return word in self.words or word.lower() in self.words

    def alive(self, run: str, blanks: tuple[int, ...]) -> bool:
        """Whether ``run`` is the beginning of some row of lexicon words none of which ends at a blank, confusions allowed as in ``decode``."""
        key = (run.lower(), blanks)
        known = self._alive.get(key)
        if known is None:
            seen, todo, known = {0}, [0], False
            while todo and not known:
                i = todo.pop()
                options, known = self._walk(key[0], i, 2 if i == 0 else 1)
                for (j, word), wrong in options.items():
                    short = j - i <= 2  # the conditions on parts of a run are those of decode
                    if j in seen or j in blanks or j - i == 1 or (short and wrong) or wrong > 1 or self.words[word] < (self.common_short if short else self.common):
                        continue
                    if j - i >= 4 or not any(i < x < j for x in blanks):
                        seen.add(j)
                        todo.append(j)
            if len(self._alive) > 300_000:
                self._alive.clear()
            self._alive[key] = known
        return known

    def begins(self, form: str) -> bool:
        k = bisect_left(self.order, form)
        return k < len(self.order) and self.order[k].startswith(form)

    def goes_on(self, a: str, b: str) -> bool:
        """Whether a word can begin with ``a`` and go on with ``b``, as it stands or misread."""
        a = a.lower()
        return self.begins(a + b[0].lower()) or any(b.startswith(x) and self.begins(a + y[0]) for x, y, _ in _BY_FIRST.get(b[0], ()))

    def starts(self, run: str, at: int, most: int) -> dict[tuple[int, str], int]:
        """(end, lexicon word) of all that can be read from ``at`` on with at most ``most`` confusions, and how many it takes.

        Only beginnings of words are followed, so neither the run nor the words have to be short.
        """
        return self._walk(run, at, most)[0]

    def _walk(self, run: str, at: int, most: int) -> tuple[dict[tuple[int, str], int], bool]:
        """What ``starts`` gives, and whether a word or the beginning of one reaches the end of the run."""
        words, out, reached = self.order, {}, False
        seen = {(at, ""): 0}
        todo = [(at, "")]
        while todo:
            state = todo.pop()
            pos, form = state
            wrong = seen[state]
            if form in self.words:
                out[state] = wrong
            if pos == len(run):
                reached = True
                continue
            steps = [(pos + 1, form + run[pos], wrong)]
            for misread, true, n in _BY_FIRST.get(run[pos], ()):
                if wrong + n <= most and run.startswith(misread, pos):
                    steps.append((pos + len(misread), form + true, wrong + n))
            for end, longer, n in steps:
                k = bisect_left(words, longer)
                if k < len(words) and words[k].startswith(longer) and n < seen.get((end, longer), most + 1):
                    seen[end, longer] = n
                    todo.append((end, longer))
        return out, reached

    def readings(self, segment: str, most: int = 2) -> list[tuple[int, str]]:
        """Lexicon words that ``segment`` can be a misreading of, with the least number of confusions."""
        found = [(n, word) for (end, word), n in self.starts(segment, 0, most).items() if end == len(segment)]
        least = min((n for n, _ in found), default=0)
        return sorted(x for x in found if x[0] == least)

    def decode(self, run: str, whole: bool = False, single: bool = False) -> tuple[str, ...] | None:
        """The cheapest reading of a run of characters as lexicon words; None if there is none.

        ``whole``: as one word; ``single``: words of one letter may be part of it.
        """
        key = run.lower()
        if whole:
            found = self.readings(key, 3)
            return (max(found, key=lambda x: (-x[0], self.words[x[1]]))[1],) if found else None
        if (key, single) in self._memo:
            return self._memo[key, single]
        n = len(key)
        best: list[tuple[float, int, str] | None] = [None] * (n + 1)  # cost, where the last word begins, the word
        best[0] = (0.0, 0, "")
        for i in range(n):
            if best[i] is None:
                continue
            options = self.starts(key, i, 2 if i == 0 else 1)
            for (j, word), wrong in options.items():
                part = i > 0 or j < n
                short = j - i <= 2
                if (j - i == 1 and n > 1 and not single) or (short and wrong) or (part and (wrong > 1 or self.words[word] < (self.common_short if short else self.common))):
                    continue  # a part of a joined run has to be a common word
                cost = best[i][0] + 1 + wrong + (1.5 if short else 0)
                if best[j] is None or cost < best[j][0] or (cost == best[j][0] and i == best[j][1] and self.words[word] > self.words[best[j][2]]):
                    best[j] = (cost, i, word)
        found = None
        if n and best[n] is not None and best[n][0] <= max(6, _COST_A_LETTER * n):
            words, j = [], n
            while j:
                words.append(best[j][2])
                j = best[j][1]
            found = tuple(words[::-1])
        if len(self._memo) > 300_000:
            self._memo.clear()
        self._memo[key, single] = found
        return found


def clean_counts(text: str, words: Counter, letters: Counter, pairs: Counter) -> None:
    plain = _NOT_PROSE.sub(" ", text)
    found = [w.lower() for w in _WORD.findall(_CJKS.sub(" ", plain))]
    words.update(found)
    for w in found:
        if "-" in w or "'" in w or "’" in w:
            words.update(_JOINT.split(w))
    letters.update(c for c in plain if c.isalpha())
    for r in _CJKS.findall(text.replace("\r", "").replace("\n", "")):
        pairs.update(r[i : i + 2] for i in range(len(r) - 1))


def word_faults(text: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, repair) of what is wrong with the words of a text without furniture."""
    out = stream_faults(text, lex)
    taken = [(s, e) for s, e, _, _ in out]
    at = 0
    for m in _CHUNK.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        out += [(s + i, s + j, kind, fixed) for i, j, kind, fixed in _chunk_faults(m.group(), lex)]
    return out


#: Cost of a run of letters that is no word, of a blank or line end left out, and of a hyphen that stays at a line end.
_NO_WORD, _DROPPED, _KEPT = 4.0, 0.5, 4.1
#: The words of one letter.
_ONE_LETTER = frozenset("aàyoiô")


class _Piece:
    """A run of letters of the stream, what parts it from the run before, and its cost as a word of its own."""

    __slots__ = ("cost", "end", "gap", "letters", "solid", "start")

    def __init__(self, start: int, end: int, letters: str, gap: str | None, cost: float):
        self.start, self.end, self.letters, self.gap, self.cost = start, end, letters, gap, cost
        self.solid = False  # part of something with digits or signs: only a hyphen can join it

    def look_around(self, text: str) -> None:
        a, b = self.start, self.end
        while a > 0 and text[a - 1] in _LEAD:
            a -= 1
        while b < len(text) and text[b] in _TAIL:
            b += 1
        self.solid = (a > 0 and not text[a - 1].isspace() and self.gap != "hyphen") or (b < len(text) and not text[b].isspace() and _GAP.match(text, self.end) is None)
        if self.solid:
            self.cost = 1.0


def stream_faults(text: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """What is wrong where words are parted: joint segmentation of the stream of letters, blanks, line ends and hyphens.

    Only stretches with something that is no word, or with a hyphen at a line
    end, are decoded: where every run is a word the reading as it stands is
    the cheapest. Blank lines and other signs end a stretch.
    """
    out: list[tuple[int, int, str, str]] = []
    stretch: list[_Piece] = []
    costs = lex.costs
    previous, reason = -1, False

    def close() -> None:
        nonlocal reason
        if reason and len(stretch) > 1:
            for p in stretch:
                p.look_around(text)
            run = []
            for p in stretch:
                if run and p.gap == "hyphen" and lex.has(run[-1].letters + p.letters):  # no reading is cheaper
                    run[-1] = _Piece(run[-1].start, p.end, run[-1].letters + p.letters, run[-1].gap, 1.0)
                    out.append((run[-1].start, p.end, "cut", run[-1].letters))
                else:
                    run.append(p)
            if any(p.cost == _NO_WORD or (k and p.gap == "hyphen") for k, p in enumerate(run)):
                out.extend(_segment(run, lex))
        stretch.clear()
        reason = False

    for m in _RUN.finditer(text):
        s, e = m.span()
        letters = m.group()
        gap = None
        if previous >= 0:
            if s - previous == 1:
                gap = _ONE_SIGN.get(text[previous])
            elif (g := _GAP.fullmatch(text, previous, s)) is not None:
                gap = g.lastgroup
        if gap is None:
            close()
        cost = costs.get(letters) or _own_cost(letters, lex)
        reason = reason or cost == _NO_WORD or gap == "hyphen"
        stretch.append(_Piece(s, e, letters, gap, cost))
        previous = e
    close()
    return _outer(out)


def _outer(faults: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """In order, without those within another."""
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(faults, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _own_cost(letters: str, lex: Lexicon) -> float:
    known = lex.costs.get(letters)
    if known is None:
        word = lex.has(letters) and (len(letters) > 1 or letters.lower() in _ONE_LETTER)
        known = 1.0 if word else 1.5 if len(letters) > 1 and letters.islower() and lex.decode(letters) else _NO_WORD
        if len(lex.costs) > 300_000:
            lex.costs.clear()
        lex.costs[letters] = known
    return known


def _compound(a: str, b: str, lex: Lexicon) -> bool:
    return lex.has(f"{a}-{b}") and not lex.has(a + b)


def _segment(run: list[_Piece], lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """The cheapest segmentation of a stretch into words; those that are not as they stand are given back.

    From every piece on, pieces are joined as long as what they spell can
    still become words, so that the work grows with the length of the stretch.
    """
    n = len(run)
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] + [(float("inf"), 0, None)] * n
    reason = max(k for k, p in enumerate(run) if p.cost == _NO_WORD or (k and p.gap == "hyphen"))  # nothing is joined beyond it
    for i, first in enumerate(run):
        base = best[i][0]
        kept = _KEPT if i and first.gap == "hyphen" and not _compound(run[i - 1].letters, first.letters, lex) else 0.0
        if base + first.cost + kept <= best[i + 1][0]:
            best[i + 1] = (base + first.cost + kept, i, None)
        if i > reason:
            continue
        joined, dropped, odd, cut = first.letters, 0.0, first.cost == _NO_WORD, False
        single, spaced = len(joined) == 1, True
        blanks: list[int] = []  # where they were in what is joined
        for j in range(i + 2, n + 1):
            a, b = run[j - 2], run[j - 1]
            single = single and len(b.letters) == 1
            spaced = spaced and b.gap in ("blank", "line")
            if b.gap == "hyphen":
                if _compound(a.letters, b.letters, lex):
                    break
                cut = True
            else:
                if a.solid or b.solid or not (b.letters.islower() or joined.isupper() and b.letters.isupper() or single):
                    break
                if j == i + 2 and first.cost == 1.0 and not single and not lex.goes_on(first.letters, b.letters):
                    break  # no word goes on where this one ends
                dropped += _DROPPED
                blanks.append(len(joined))
            joined += b.letters
            odd |= b.cost == _NO_WORD
            spelt = single and spaced and len(joined) > 3
            so_far = base + (dropped / 2 if spelt else dropped)  # a blank after every letter is one mistake
            if (odd or cut) and len(joined) >= 3 and so_far + 1 < best[j][0]:
                if spelt:
                    got = lex.decode(joined, single=True)
                    best[j] = (so_far + 1, i, " ".join(got) if got else joined)
                elif lex.has(joined):
                    best[j] = (so_far + 1, i, joined)
                elif odd and joined.islower() and (got := lex.decode(joined)) and so_far + len(got) + 1 < best[j][0] and _bridged(got, [len(joined) - x for x in blanks]):
                    best[j] = (so_far + len(got) + 1, i, " ".join(got))
                elif cut and not blanks and so_far + _NO_WORD < best[j][0]:
                    best[j] = (so_far + _NO_WORD, i, joined)
            if not single and not lex.alive(joined, tuple(blanks)):
                break
    out, j = [], n
    while j:
        _, i, word = best[j]
        if word is not None:
            kind = "spaced" if all(p.gap in ("blank", "wide") for p in run[i + 1 : j]) else "cut"
            out.append((run[i].start, run[j - 1].end, kind, word))
        j = i
    return out[::-1]


def _bridged(words: tuple[str, ...], ends: list[int]) -> bool:
    """Whether every blank, counted from the end, was inside a word of some length, and no word is a letter."""
    at, inside = 0, 0
    for w in reversed(words):
        inside += sum(at < x < at + len(w) for x in ends) if len(w) >= 4 else 0
        at += len(w)
    return inside == len(ends) and min(map(len, words)) >= 2


def _chunk_faults(chunk: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """Faults of what stands between white space, by position in it; each distinct chunk is looked at once."""
    known = lex.chunks.get(chunk)
    if known is not None:
        return known
    out = []
    lead = len(chunk) - len(chunk.lstrip("\"'“„«(〈<[·—–-•*"))
    core = chunk[lead:].rstrip("\"'”“»).,;:!?…>]·—–-")
    if core and _LETTER.search(core):
        for part in _PART.finditer(core):
            word = part.group().strip(".,;:'’\"")
            if len(word) < 2 or not _LATIN.search(word) or _CODE.fullmatch(word):
                continue
            fault = _fault(word, lex)
            if fault is not None:
                out.append((lead + part.start(), lead + part.end(), *fault))
    if len(lex.chunks) > 300_000:
        lex.chunks.clear()
    lex.chunks[chunk] = out
    return out


def _fault(word: str, lex: Lexicon) -> tuple[str, str] | None:
    if lex.has(word) and not _HUMP.search(word):
        return None
    if _SHORT.fullmatch(word) or ("_" in word or ":" in word):
        return None
    letters = _NO_LETTER.sub("", word)
    low = letters.lower()
    if _BLOT.search(word) or (_APOSTROPHE.search(word) and not _elided(word, lex)):
        base = _BLOTS.sub("", word)
        got = lex.decode(base, whole=True)
        return "sign", got[0] if got else base
    if _DIGIT.search(word):
        if regex.search(r"\p{L}{2}", word) or regex.fullmatch(r"\p{Ll}\d|\d\p{Ll}", word) is None and regex.search(r"\p{Ll}", word):
            got = lex.decode(word, whole=True)
            if got or (regex.search(r"\p{Ll}\d|\d\p{Ll}", word) and "-" not in word):
                return "misread", got[0] if got else word
        return None
    if any(c not in lex.known and c.lower() not in lex.known for c in letters):
        got = lex.decode(word, whole=True)
        return "misread", got[0] if got else word
    parts = [p for p in _JOINT.split(word) if p]
    if _HUMP.search(word) and (low in lex.words or low not in lex.words and not any(lex.has(p) for p in regex.split(r"(?<=\p{Ll})(?=\p{Lu})", word))):
        return "case", word[0] + word[1:].lower()
    for p in parts:
        if len(p) < 2 or lex.has(p):
            continue
        if p.isupper() and len(p) > 3:
            continue
        if p.islower():
            got = lex.decode(p)
            if got:
                return ("joined" if len(got) > 1 else "misread"), word.replace(p, " ".join(got))
        else:
            got = [w for d, w in lex.readings(p.lower(), 2) if d]
            if got and max(lex.words[w] for w in got) >= lex.common / 2:
                return "misread", word.replace(p, max(got, key=lambda w: lex.words[w]).capitalize())
    return None


def _elided(word: str, lex: Lexicon) -> bool:
    head = _ELISION.split(word)[0]
    return len(head) <= 2 and head.lower() in {"d", "l", "n", "s", "j", "c", "m", "t", "qu"} or lex.has(word) or _ENGLISH.search(word) is not None


def cjk_faults(text: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """Misread CJK characters. A line end inside Chinese text is none: its lines are broken at any character."""
    out = []
    for m in _SPACED_CJK.finditer(text):
        word = m.group()[::2]
        if any(lex.pairs.get(word[i : i + 2], 0) for i in range(len(word) - 1)):
            out.append((*m.span(), "spaced", word))
    done = [(s, e) for s, e, _, _ in out]
    for m in _GAP_CJK.finditer(text):
        s, e = m.span()
        if lex.cohesion(text[s - 1], text[e]) >= 0.2 and not any(s < y and e > x for x, y in done):
            out.append((s, e, "spaced", ""))
    flat = [(i, c) for i, c in enumerate(text) if c not in "\r\n"]
    for k, (i, c) in enumerate(flat):
        true = CJK_CONFUSIONS.get(c)
        if c in CJK_UNREAD and c not in lex.known:
            out.append((i, i + 1, "misread", true if c != "囗" else c))
            continue
        if true is None:
            continue
        before = flat[k - 1][1] if k else " "
        after = flat[k + 1][1] if k + 1 < len(flat) else " "
        for now, then in ((before + c, before + true), (c + after, true + after)):
            if lex.pairs.get(then, 0) >= max(1, lex.telling) and lex.pairs.get(now, 0) * 50 < lex.pairs[then]:
                other = lex.pairs.get(c + after if now[1] == c else before + c, 0)
                if other * 10 < lex.pairs[then]:
                    out.append((i, i + 1, "misread", true))
                    break
    return out


def paragraphs(lines: list[str], lex: Lexicon | None = None) -> list[str]:
    """Lines joined to paragraphs at least cost: leaving a sentence open costs, so does
    running on after a short line that ends one."""
    if not lines:
        return []
    width = max(map(len, lines))
    n = len(lines)
    solid = sum(map(len, _CJKS.findall("".join(lines)))) * 3 > sum(map(len, lines))  # no spaces between words
    closed = [_closed(x) for x in lines]
    short = [c and len(x) < 0.7 * width for c, x in zip(closed, lines, strict=True)]
    cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        inner = 0.0
        for i in range(j - 1, -1, -1):
            if i < j - 1 and short[i]:
                inner += 1.5
            total = cost[i] + inner + 0.5 + (0.0 if j == n or closed[j - 1] else 3.0)
            if total < cost[j]:
                cost[j], back[j] = total, i
            if inner > 12:
                break
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    out = []
    for i, j in reversed(cuts):
        text = lines[i].strip()
        for line in lines[i + 1 : j]:
            line = line.strip()
            close = solid or not text or not line or _CJKS.fullmatch(text[-1]) or _CJKS.fullmatch(line[0]) or text[-1] in "。，、；：！？"
            text += line if close else " " + line
        out.append(text)
    return [x for x in out if x]


def _closed(line: str) -> bool:
    return _CLOSING.search(line) is not None


def _join_end(body: str, at: int, lex: Lexicon) -> str:
    """What becomes of the line end at ``at`` in Chinese text: it stays after a hyphen in a word, is a blank between Latin words, else goes."""
    left, right = _LAST_WORD.search(body, 0, at), _FIRST_WORD.match(body, at + 1)
    if left is None or right is None:
        return ""
    if left["hyphen"]:
        return "\n"
    a, b = left["word"], right["word"]
    return " " if lex.has(a) and lex.has(b) and not lex.has(a + b) else ""


def repair(text: str, drop: set[int], lex: Lexicon) -> tuple[list[str], str]:
    """Kinds of faults of a block's text, and the text without them as paragraphs."""
    lines = split_lines(text)
    gone = {i for i, x in enumerate(lines) if i in drop}
    kinds = ["furniture"] * bool(gone)
    body = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    if sum(map(len, _CJKS.findall(body))) * 3 > len(body):
        body = _ONE_END.sub(lambda m: _join_end(body, m.start(), lex), body)  # Chinese lines end anywhere, also inside a name
    faults = word_faults(body, lex) + (cjk_faults(body, lex) if _CJKS.search(body) else [])
    kinds += sorted({k for _, _, k, _ in faults})
    out, at = [], 0
    for s, e, _, fixed in sorted(faults):
        if s >= at and (s, e) != (at, at):
            out += [body[at:s], fixed]
            at = e
    out.append(body[at:])
    blocks = _BLANK.split("".join(out))
    return kinds, "\n\n".join(p for b in blocks for p in paragraphs([x for x in b.split("\n") if x.strip()]))


def scanned_faults(blocks: DataFrame, documents: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """document_id, block_id, kinds, clean of every block of scanned documents that has something wrong.

    What stands in the margin of its page and doesn't end a sentence is
    furniture, and so is every line of the document that looks like it; so is
    what opens or closes at least half of the document's pages (three at least)
    inside blocks of text or in blocks of unknown place, and never stands alone
    within the page as a minor heading does.
    ``clean`` is "" for blocks that are furniture altogether. Numbers in tables
    are none. Null and empty texts have nothing wrong; blocks delivered twice
    are one block; blocks without a document are not scanned; a missing or
    partial box counts as unknown, and then the block's type and the document's
    other furniture decide.
    """
    ship_package(blocks.sparkSession)
    flags = documents.groupBy(F.col("package_id").alias("document_id")).agg(F.max(F.coalesce(F.col("source_uri").endswith(suffix), F.lit(False))).alias("scan"))
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    typed = F.col("block_type").isin("header", "footer", "page_number")
    margin = F.when(middle.isNotNull(), (middle <= TOP_EDGE) | (middle >= BOTTOM_EDGE)).otherwise(F.when(typed, True))
    order = F.col("reading_order") if "reading_order" in blocks.columns else F.lit(0)
    rows = (
        blocks.where(F.length("text") > 0)
        .select("document_id", "block_id", "page_number", "block_type", "text", order.alias("reading_order"), margin.alias("edge"))
        .join(flags, "document_id", "left")
        .withColumn("scan", F.coalesce("scan", F.lit(False)))
        .dropDuplicates(["document_id", "block_id"])
    )
    every = settle(rows, "scan")
    scans = every.where("scan")
    lexicon = blocks.sparkSession.sparkContext.broadcast(_lexicon(every.where("not scan")))

    def lines(batches):
        """Lines that can be furniture; ``edge``: in the margin; ``alone``: all of a block within the page; ``first``, ``last``: of their block."""
        for batch in batches:
            keep, number, mark, side, alone, first, last = [], [], [], [], [], [], []
            for r, (t, kind, edge) in enumerate(zip(batch.column("text").to_pylist(), batch.column("block_type").to_pylist(), batch.column("edge").to_pylist(), strict=True)):
                whole = in_margin(t, edge)
                parts = split_lines(t)
                if kind == "table" and len(parts) > 1 and not whole:
                    continue
                for i, line in enumerate(parts):
                    page = (whole or kind != "table") and is_page_number(line)
                    s = "" if page else skeleton(line)
                    if page or s:
                        keep.append(r)
                        number.append(i)
                        mark.append("#" if page else s)
                        side.append(whole)
                        alone.append(edge is False and len(parts) == 1)
                        first.append(i == 0)
                        last.append(i == len(parts) - 1)
            own = batch.take(pa.array(keep, pa.int64()))
            names = ["document_id", "block_id", "page_number", "reading_order"]
            yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(number, pa.int32()), pa.array(mark, pa.string()), *(pa.array(x, pa.bool_()) for x in (side, alone, first, last))], [*names, "line", "mark", "edge", "alone", "first", "last"])

    found = "document_id string, block_id string, page_number int, reading_order int, line int, mark string, edge boolean, alone boolean, first boolean, last boolean"
    candidates = settle(scans.select("document_id", "block_id", "page_number", "reading_order", "block_type", "text", "edge").mapInArrow(lines, found), "lines")
    inner = candidates.where("not edge")
    words = candidates.where("mark <> '#'")
    ends = scans.where("edge is null or not edge").groupBy("document_id", "page_number").agg(F.min(F.struct("reading_order", "block_id"))["block_id"].alias("top"), F.max(F.struct("reading_order", "block_id"))["block_id"].alias("bottom"))
    pages = ends.groupBy("document_id").agg(F.count("*").alias("pages"))
    outer = words.where("not edge and (first or last)").join(ends, ["document_id", "page_number"]).where((F.col("first") & (F.col("block_id") == F.col("top"))) | (F.col("last") & (F.col("block_id") == F.col("bottom"))))
    again = outer.groupBy("document_id", "mark").agg(F.countDistinct("page_number").alias("n")).join(pages, "document_id").where("n >= 3 and n * 2 >= pages").select("document_id", "mark").join(words.where("alone"), ["document_id", "mark"], "left_anti")
    furniture = words.where("edge").select("document_id", "mark").unionByName(again).distinct()
    numbers = inner.where("mark = '#'").select("document_id", "block_id", "line")
    running = inner.where("mark <> '#'").join(furniture, ["document_id", "mark"], "left_semi").select("document_id", "block_id", "line")
    drops = numbers.unionByName(running).groupBy("document_id", "block_id").agg(F.collect_set("line").alias("drop"))  # lines of one block

    def mend(batches):
        lex = lexicon.value
        for batch in batches:
            keep, kinds, clean = [], [], []
            for r, (t, edge, drop) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "edge", "drop")), strict=True)):
                if in_margin(t, edge):
                    faults, text = ["furniture"], ""
                else:
                    faults, text = repair(t, set(drop or ()), lex)
                if faults:
                    keep.append(r)
                    kinds.append(faults)
                    clean.append(text)
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("document_id"), own.column("block_id"), pa.array(kinds, pa.list_(pa.string())), pa.array(clean, pa.string())], ["document_id", "block_id", "kinds", "clean"])

    ready = scans.join(drops, ["document_id", "block_id"], "left").select("document_id", "block_id", "text", "edge", "drop")
    return ready.mapInArrow(mend, "document_id string, block_id string, kinds array<string>, clean string")


def in_margin(text: str, edge: bool | None) -> bool:
    """Whether a block is furniture by where it stands: in the margin, and no sentence."""
    return edge is True and not _closed(text)


def _lexicon(clean: DataFrame) -> Lexicon:
    """Counts over all clean texts; entries below LEAST_SHARE of their kind are left out, which bounds them at every size."""

    def count(batches):
        words, letters, pairs = Counter(), Counter(), Counter()

        def flush():
            entries = [(k, w, n) for k, c in (("w", words), ("c", letters), ("p", pairs)) for w, n in c.items()]
            for c in (words, letters, pairs):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in entries], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "entry", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                clean_counts(t, words, letters, pairs)
            if len(words) > 200_000:
                yield flush()
        yield flush()

    counts = settle(clean.select("text").mapInArrow(count, "kind string, entry string, n bigint").groupBy("kind", "entry").agg(F.sum("n").alias("n")), "lexicon")
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # three kinds
    found: dict[str, dict[str, int]] = {"w": {}, "c": {}, "p": {}}
    share = F.create_map(*(F.lit(x) for k in found for x in (k, LEAST_SHARE * (totals.get(k) or 0))))
    for r in counts.where(F.col("n") >= F.element_at(share, F.col("kind"))).toLocalIterator():
        found[r.kind][r.entry] = r.n
    return Lexicon(found["w"], found["c"], found["p"])

"""Text decoded with the wrong character encoding: a hidden Markov model over encoding pairs, and its repair.

States: clean text; for each pair (written in, read in) text that was written in one encoding and read in the other; and
characters lost to the replacement mark. In the clean state a character is emitted as it stands; in the state of a pair
the original character is emitted, and what stands there is what its bytes look like when read wrongly. Both are
scored by the same character statistics, counted over all documents, so a span is given to a pair exactly where the text
it would restore is that much likelier than the text as it stands to pay for the change of state.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (written in, read in). Of pairs that explain a span equally well the first counts.
PAIRS = [
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp1250"),
    ("utf-8", "koi8_r"),
    ("utf-8", "cp866"),
    ("utf-8", "cp1253"),
    ("utf-8", "cp1254"),
    ("utf-8", "iso8859_2"),
    ("euc_jp", "cp1252"),
    ("shift_jis", "cp1252"),
    ("shift_jis", "latin-1"),
    ("gbk", "cp1252"),
    ("big5", "cp1252"),
    ("euc_kr", "cp1252"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"),
    ("koi8_r", "cp1252"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("iso8859_5", "cp1252"),
    ("mac_cyrillic", "cp1252"),
    ("cp1253", "cp1252"),
    ("cp1252", "latin-1"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1250", "cp1252"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
]
LOST = "\ufffd"
#: Ways a pair writes: UTF-8 sequences, two bytes a character, one byte a letter of another script, one byte a Latin letter.
_DOUBLE, _LATIN_PAGES = ("euc_jp", "shift_jis", "gbk", "big5", "euc_kr"), ("cp1252", "mac_roman", "cp437", "cp850", "cp1250")
#: Costs in nats: entering or leaving the state of a pair written in UTF-8, whose bytes vouch for each other, of a pair of two Latin code pages, where single letters stand for single letters, or of another pair; a Latin letter inside a span of a pair that writes another script; at most that much for one stretch of ASCII.
SWITCH, SWITCH_LATIN, SWITCH_OTHER, STRANGE, STRANGE_MOST = 2.0, 9.0, 5.0, 0.5, 4.0
#: Log-likelihood of a character that no document has; at least that of any letter or mark in everyday use, and of any Han or Hangul character.
UNSEEN, EVERYDAY, HAN = -25.0, -14.0, -18.0
#: Cost of entering or leaving the state of a pair not written in UTF-8 or a Latin code page in the middle of a word, and of a small Cyrillic or Greek letter that opens a sentence.
SPLIT, SMALL = 6.0, 4.0
#: Cost on top for other pairs in a text that is mostly of one pair.
ODD_ONE = 2.5
#: A span must gain this much over the clean reading.
LEAST_GAIN = 3.0
#: Mean log-likelihood that restored letters of a script written in two bytes, or in one, must reach to be believed.
BELIEVED_DOUBLE, BELIEVED_SINGLE = -15.0, -4.8
#: Characters decoded at once, unless there is no gap to cut at; gap that ends a cluster, and that in a text of Latin code pages.
CLUSTER, GAP, LATIN_GAP = 4000, 40, 600

_CODE = re.compile(r"(?<!`)`(?!`)[^`\n]+(?<!`)`(?!`)")
_TOKEN = re.compile("[\x00-\x7f]+|[^\x00-\x7f]")
_LATIN = re.compile("[A-Za-z]")
#: A letter of another script right beside a Latin one: text that was not put together like this by anybody.
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[À-ɏ][ぁ-鿿가-힣]|[ぁ-鿿가-힣][À-ɏ]")


def _readings(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half; bytes the encoding leaves open are read as control characters, as browsers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _latin_pair(written: str, read: str) -> bool:
    return written in _LATIN_PAGES and (written, read) != ("cp1252", "latin-1")


#: Two neighbours that some encoding's bytes may look like, a control character of the upper half or a lost character.
_SUSPECT = re.compile("[%s]{2}|[\x80-\x9f]|%s" % (re.escape("".join(sorted({c for w, r in PAIRS if not _latin_pair(w, r) for c in _readings(r)}))), LOST))
#: A Shift-JIS character whose second byte is ASCII. Text without this and without suspicion is clean.
_SHIFTED = re.compile("[%s][@-~]" % re.escape("".join(sorted({c for w, r in PAIRS if w == "shift_jis" for c, b in _readings(r).items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC}))))


#: What stands or is restored in text of two Latin code pages.
_PAGES = re.compile("[%s]" % re.escape("".join(sorted({c for w, r in PAIRS if _latin_pair(w, r) for codec in (w, r) for c in _readings(codec)}))))


def _paired(c: str) -> bool:
    """Cyrillic and Greek, the letters scored by pair."""
    return "Ͱ" <= c <= "ӿ"


def _kind(c: str) -> str:
    return "." if not c.isalpha() else "l" if c.isascii() else "h"


def _context(text: str, at: int, end: int) -> str:
    """What stands before `at` and from `end`: an ASCII letter, another letter, or neither."""
    return _kind(text[at - 1 : at]) + _kind(text[end : end + 1])


def _opens(text: str, at: int) -> bool:
    """Whether a sentence or line begins at `at`."""
    before = text[max(0, at - 2) : at]
    return not before or before[-1] == "\n" or (len(before) == 2 and before[1] == " " and before[0] in ".!?")


def _everyday(c: str) -> bool:
    """Letters and marks of Western, Greek, Cyrillic and Japanese writing, which a small corpus may happen not to hold."""
    return "\xa1" <= c <= "ž" or "Ё" <= c <= "ё" or "Ά" <= c <= "ώ" or c in "‘’‚“”„–—…•€™ŒœŸŠšŽž\xa0" or "\u3000" <= c <= "ヿ" or "！" <= c <= "～"


class CharModel:
    """Log-likelihood of a character after another, from counts over a corpus.

    Letters after letters of Cyrillic and Greek are scored by pair without case, and by the change of case; others singly.
    Single letters of two Latin code pages are compared by how often they stand in a place like this one.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        single = {k[1:]: n for k, n in counts.items() if k[0] == "u"}
        self.total = sum(single.values()) + 1.0
        self.single = {c: math.log(n / self.total) for c, n in single.items()}
        self.pair = {k[1:]: n for k, n in counts.items() if k[0] == "p"}
        self.head = Counter()
        for ab, n in self.pair.items():
            self.head[ab[0]] += n
        self.placed = {k[1:]: n for k, n in counts.items() if k[0] == "x"}
        self.known: dict[str, float] = {}  # scores by character, or by two of a paired script: bounded by the characters there are
        case = {k[1:]: n for k, n in counts.items() if k[0] == "c"}
        self.case = {ab: math.log((n + 1) / (sum(m for k, m in case.items() if k[0] == ab[0]) + 4)) for ab, n in ((a + b, case.get(a + b, 0)) for a in "ul" for b in "ul")}

    def score(self, c: str, before: str) -> float:
        if before and "Ͱ" <= c <= "ӿ" and _paired(before):
            key = before + c
            if key not in self.known:
                a, b = before.lower(), c.lower()
                p = (self.pair.get(a + b, 0) + 5 * math.exp(self.single.get(b, EVERYDAY))) / (self.head.get(a, 0) + 5)
                self.known[key] = math.log(max(p, 1e-9)) + self.case[("u" if before != a else "l") + ("u" if c != b else "l")]
            return self.known[key]
        one = self.known.get(c)
        if one is None:
            floor = EVERYDAY if _everyday(c) else HAN if "一" <= c <= "龥" or "가" <= c <= "힣" else UNSEEN
            # control characters, where a corpus has them, come from wrong readings
            one = self.known[c] = UNSEEN if "\x80" <= c <= "\x9f" else max(self.single.get(c, UNSEEN), floor)
        return one

    def likelier(self, c: str, stands: str, place: str) -> float:
        """By how much c is likelier than what stands there, in such a place."""
        return min(8.0, max(-8.0, math.log((self.placed.get(place + c, 0) + 0.5) / (self.placed.get(place + stands, 0) + 0.5))))


def char_counts(docs: DataFrame) -> dict[str, int]:
    """Counts over all documents: single characters, also by place, Cyrillic and Greek pairs without case, changes of case. Added up per task, then by key; bounded by the characters of Unicode in use, not by the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pair, case, placed = Counter(), Counter(), Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                if t.isascii():
                    single["a"] += len(t)
                    continue
                high = Counter(re.findall("[^\x00-\x7f]", t))
                single.update(high)
                single["a"] += len(t) - sum(high.values())
                placed.update(_context(t, m.start(), m.end()) + m.group() for m in _PAGES.finditer(t))
                for run in re.findall("[Ͱ-ӿ]{2,}", t):
                    low = run.lower()
                    pair.update(map(str.__add__, low, low[1:]))
                    shape = "".join("l" if x == y else "u" for x, y in zip(run, low))
                    case.update(map(str.__add__, shape, shape[1:]))
        rows = [(k + c, n) for k, counted in (("u", single), ("p", pair), ("c", case), ("x", placed)) for c, n in counted.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["k", "n"])

    got = docs.select("text").mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {r["k"]: r["n"] for r in got}


def _lengths(written: str, lead: int, latin: bool) -> tuple[int, int]:
    """Fewest and most bytes of a character that begins with this one; (0, 0) if none does."""
    if written == "utf-8":
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        return n, n
    if written == "shift_jis":
        return (1, 1) if 0xA1 <= lead <= 0xDF else (2, 2)
    if written in _DOUBLE:
        return (2, 2) if 0x81 <= lead <= 0xFE else (0, 0)
    if written == "cp1252" and not latin:  # read as latin-1: differs in the control characters only
        return (1, 1) if lead <= 0x9F else (0, 0)
    return 1, 1


class Model:
    """The hidden Markov model, ready to label texts."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.chars = CharModel(counts)
        self.latin = [_latin_pair(w, r) for w, r in PAIRS]
        self.utf8 = [w == "utf-8" for w, _ in PAIRS]
        self.splits = [not u and not x and p != ("cp1252", "latin-1") for u, x, p in zip(self.utf8, self.latin, PAIRS)] + [False, False]
        self.cost = [SWITCH if u else SWITCH_LATIN if x else SWITCH_OTHER for u, x in zip(self.utf8, self.latin)] + [0.0, 0.0]  # the last two: clean (-2), lost (-1)
        self.tables = [_readings(r) for _, r in PAIRS]
        #: character -> (state, byte, fewest and most tokens of the character that begins with it)
        self.leads: dict[str, list[tuple[int, int, int, int]]] = {}
        for s, (w, _) in enumerate(PAIRS):
            for c, lead in self.tables[s].items():
                few, most = _lengths(w, lead, self.latin[s])
                if most:
                    self.leads.setdefault(c, []).append((s, lead, few, most))
        self.other_leads = {c: [x for x in xs if not self.latin[x[0]]] for c, xs in self.leads.items()}
        self.units: dict = {}
        self.shifted: dict[str, bool] = {}
        self.odd: dict[str, float] = {}

    def unit(self, s: int, lead: int, few: int, most: int, after: str) -> tuple[str, int] | None:
        """The original character of pair s that begins with the byte `lead`, with the characters after it, and how many tokens it takes."""
        key = (s, lead, after[: most - 1])
        if key in self.units:
            return self.units[key]
        written, table, got = PAIRS[s][0], self.tables[s], None
        raw = bytearray([lead])
        for n in range(1, most + 1):
            if n > 1:
                t = key[2][n - 2 : n - 1]
                b = table.get(t)
                if b is None and written in ("shift_jis", "gbk", "big5") and t.isascii() and "@" <= t <= "~":
                    b = ord(t)
                if b is None:
                    break
                raw.append(b)
            if n >= few:
                try:
                    c = bytes(raw).decode(written)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    got = (c, n)
                    break
        if len(self.units) > 200_000:
            self.units.clear()
        self.units[key] = got
        return got

    def _marks(self, text: str, latin: bool) -> tuple[list[int], bool]:
        """Where suspicious characters stand, and whether these are letters of Latin code pages.

        A Shift-JIS character with an ASCII byte counts if it is likelier than what stands there, as one of a span must be. Letters
        that other letters would be likelier for, in their places, count if all of them in the text outweigh the change of state.
        """
        at = {m.start() for m in _SUSPECT.finditer(text)}
        for m in _SHIFTED.finditer(text):
            if m.start() not in at and self._shifted(m.group()):
                at.add(m.start())
        if not latin:
            return sorted(at), False
        odd, weight = [], 0.0
        for m in _PAGES.finditer(text):
            x = self._odd(_context(text, m.start(), m.end()), m.group())
            if x > 0:
                odd.append(m.start())
                weight += x
        if weight < 2 * SWITCH_LATIN:
            return sorted(at), False
        return sorted(at.union(odd)), True

    def _shifted(self, two: str) -> bool:
        if two not in self.shifted:
            units = [self.unit(s, lead, few, most, two[1]) for s, lead, few, most in self.leads.get(two[0], ()) if PAIRS[s][0] == "shift_jis"]
            self.shifted[two] = any(u and self.chars.score(u[0], "") > self.chars.score(two[0], "") for u in units)
        return self.shifted[two]

    def _odd(self, place: str, c: str) -> float:
        """The most that a Latin pair gains for the character in such a place."""
        key = place + c
        if key not in self.odd:
            units = [self.unit(s, lead, few, most, "") for s, lead, few, most in self.leads.get(c, ()) if self.latin[s]]
            self.odd[key] = max((self.chars.likelier(u[0], c, place) for u in units if u), default=0.0)
        return self.odd[key]

    def spans(self, raw: str, latin: bool = True) -> list[tuple[int, int, int, str]]:
        """(start, end, state, restored) of the most likely labelling; state -1 is lost characters, with what stands there.

        Inline code, a pair of single backticks on one line, is passed over. If several pairs occur, the text is labelled again with
        the most frequent one preferred. latin: whether pairs of Latin code pages are considered.
        """
        text, marks, pages = self._looked_at(raw, latin)
        out = [x for part in self._clusters(text, raw, marks, pages, self.cost) for x in part]
        sizes = Counter()
        for a, b, s, _ in out:
            sizes[s] += b - a
        del sizes[-1]
        if len(sizes) > 1:
            most = max(sizes, key=lambda s: (sizes[s], -s))
            cost = [c + (ODD_ONE if s != most and s < len(PAIRS) else 0.0) for s, c in enumerate(self.cost)]
            out = [x for part in self._clusters(text, raw, marks, pages, cost) for x in part]
        return out

    def _looked_at(self, raw: str, latin: bool = True) -> tuple[str, list[int], bool]:
        text = _CODE.sub(lambda m: "\0" * len(m.group()), raw) if "`" in raw else raw
        return text, *self._marks(text, latin)

    def _clusters(self, text: str, raw: str, marks: list[int], pages: bool, cost: list[float]) -> Iterator[list[tuple[int, int, int, str]]]:
        # Stretches free of suspicion cost and gain nothing: only clusters around suspicious characters are decoded. A long
        # cluster is cut, where there is a gap if possible, so that the lattice in memory is bounded for any text.
        first = last = None
        done, gap = 0, LATIN_GAP if pages else GAP
        for at in marks:
            if first is not None and (at - last > gap or (at - first > CLUSTER and at - last > 2) or at - first > 4 * CLUSTER):
                end = min(at, last + 14)
                yield self._decode(text, raw, max(done, first - 12), end, cost, pages)
                first, done = None, end
            first = at if first is None else first
            last = at
        if first is not None:
            yield self._decode(text, raw, max(done, first - 12), min(len(text), last + 14), cost, pages)

    def _decode(self, text: str, raw: str, lo: int, hi: int, cost: list[float], pages: bool) -> list[tuple[int, int, int, str]]:
        # a token is a stretch of ASCII or one other character; a stretch is cut after its first character, which may be the second byte of a Shift-JIS character
        tokens, starts = [], []
        for m in _TOKEN.finditer(text, lo, hi):
            x, at = m.group(), m.start()
            if len(x) > 1 and tokens and not tokens[-1].isascii():
                tokens += [x[0], x[1:]]
                starts += [at, at + 1]
            else:
                tokens.append(x)
                starts.append(at)
        starts.append(hi)
        n, score, leads = len(tokens), self.chars.score, self.leads if pages else self.other_leads
        clean = -2
        best: list[dict] = [{} for _ in range(n + 1)]  # state -> (score, previous position, previous state, original character)
        best[0][clean] = (0.0, -1, clean, "")
        for i in range(n):
            here = best[i]
            if not here:
                continue
            t = tokens[i]
            top = max(here, key=lambda s: here[s][0] - cost[s])
            free = here[top][0] - cost[top]

            def put(j: int, s: int, v: float, p: int, c: str) -> None:
                old = best[j].get(s)
                if old is None or v > old[0]:
                    best[j][s] = (v, i, p, c)

            opens = _opens(text, starts[i])
            own = here.get(clean)
            before = tokens[i - 1][-1] if i else ""
            in_word = before != "" and (before.isalpha() or not before.isascii())
            midword = in_word and (t[0].isalpha() or not t.isascii())
            leave = free - SPLIT if midword and self.splits[top] else free
            stay = own is not None and own[0] >= leave
            src, base = (clean, own[0]) if stay else (top, leave)
            if t.isascii():
                put(i + 1, clean, base, src, t[-1])
                letters = len(_LATIN.findall(t))
                for s, v in here.items():
                    if s >= 0:
                        strange = 0.0 if self.utf8[s] or self.latin[s] else min(STRANGE_MOST, STRANGE * letters)
                        put(i + 1, s, v[0] - strange, s, t[-1])
                continue
            own_score = score(t, before) - (SMALL if opens and _paired(t) and t.islower() else 0.0)
            if t == LOST:
                put(i + 1, -1, base, src, t)
            else:
                put(i + 1, clean, base + own_score, src, t)
            after = ""
            for x in tokens[i + 1 : i + 4]:
                if len(x) > 1:
                    break
                after += x
            for s, lead, few, most in leads.get(t, ()):
                u = self.unit(s, lead, few, most, after)
                if u is None:
                    continue
                c, k = u
                inside = here.get(s)
                if self.latin[s]:
                    at = starts[i]
                    new = score(c, "") if "\x80" <= t <= "\x9f" else own_score + self.chars.likelier(c, t, _context(text, at, at + 1))
                    stay_in = inside is not None and inside[0] >= free - cost[s]
                    put(i + k, s, (inside[0] if stay_in else free - cost[s]) + new, s if stay_in else top, c)
                    continue
                enter = free - cost[s] - (SPLIT if in_word and self.splits[s] else 0.0)
                small = SMALL if opens and _paired(c) and c.islower() else 0.0
                if inside is not None and inside[0] >= enter:
                    put(i + k, s, inside[0] + score(c, inside[3]) - small, s, c)
                else:
                    put(i + k, s, enter + score(c, "") - small, top, c)
        end = max(best[n], key=lambda s: best[n][s][0] - cost[s])
        path, j, s = [], n, end
        while j > 0:
            v, i, p, c = best[j][s]
            path.append((i, j, s, raw[starts[i] : starts[j]] if tokens[i].isascii() else c))
            j, s = i, p
        path.reverse()
        out: list[tuple[int, int, int, str]] = []
        for i, j, s, c in path:
            if s == clean:
                continue
            a, b = starts[i], starts[j]
            if out and out[-1][2] == s and out[-1][1] == a:
                out[-1] = (out[-1][0], b, s, out[-1][3] + c)
            else:
                out.append((a, b, s, c))
        trimmed = []
        for a, b, s, c in out:
            if s >= 0 and self.splits[s] and b - a > 8 and raw[a - 1 : a] == " " and _opens(text, a - 2):
                # a single letter that opens the sentence goes with it
                u = next((self.unit(s, lead, few, most, "") for k, lead, few, most in self.leads.get(raw[a - 2], ()) if k == s and most == 1), None)
                if u and u[0].isupper():
                    a, c = a - 2, u[0] + " " + c
            if s >= 0:  # ASCII at the ends belongs to the text around
                stands, end = raw[a:b], 0
                while end < min(len(stands), len(c)) and stands[-1 - end] == c[-1 - end] and c[-1 - end].isascii():
                    end += 1
                b, c = b - end, c[: len(c) - end]
                if not self.latin[s] and self._gain(raw[a:b], c) < LEAST_GAIN:
                    continue
            trimmed.append((a, b, s, c))
        return trimmed

    def _gain(self, raw: str, restored: str) -> float:
        def total(x: str) -> float:
            return sum(self.chars.score(c, x[i - 1] if i else "") for i, c in enumerate(x) if not c.isascii())

        return total(restored) - total(raw)

    def garbled(self, text: str | None) -> bool:
        """Whether a span outside inline code is garbled."""
        if not text or text.isascii():
            return False
        plain, marks, pages = self._looked_at(text)
        return any(self._clusters(plain, text, marks, pages, self.cost))  # the first span is enough

    def _believed(self, s: int, restored: str) -> bool:
        """Whether restored text reads like text. UTF-8 bytes vouch for themselves; other pairs turn any bytes into something."""
        if self.utf8[s] or self.latin[s] or PAIRS[s] == ("cp1252", "latin-1"):
            return True
        high = [(c, restored[i - 1] if i else "") for i, c in enumerate(restored) if not c.isascii()]
        mean = sum(self.chars.score(c, before) for c, before in high) / max(len(high), 1)
        return mean >= (BELIEVED_DOUBLE if PAIRS[s][0] in _DOUBLE else BELIEVED_SINGLE)

    def restore(self, text: str) -> tuple[str, list[str], bool]:
        """The text with every span restored, level by level until none is left; the pairs met; whether all could be restored.

        A span whose best restoration doesn't read like text stays as it is, and the text counts as incomplete, as it does with
        lost characters, with words of two scripts, or if restoring comes back to where it was.
        """
        met: list[str] = []
        seen = {text}
        while True:
            found = self.spans(text, latin=not met)  # what a first level brought back is not taken for another code page
            fix = [x for x in found if x[2] >= 0 and self._believed(x[2], x[3])]
            if not fix:
                return text, met, not found and not _MIXED.search(text)
            parts, at = [], 0
            for a, b, s, c in fix:
                parts += [text[at:a], c]
                at = b
                name = f"{PAIRS[s][0]}>{PAIRS[s][1]}"
                if name not in met:
                    met.append(name)
            text = "".join(parts) + text[at:]
            if text in seen:
                return text, met, False
            seen.add(text)


_ready: list = [None, None]


def _of(shared) -> Model:  # noqa: ANN001
    """The model of broadcast counts, built once per worker."""
    if _ready[0] is not shared.value:
        _ready[:] = [shared.value, Model(shared.value)]
    return _ready[1]


def garbled_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of every text with a span, outside inline code, that was read in the wrong encoding.

    One pass counts characters, one labels; texts of ASCII only never leave the JVM. Neither pass shuffles texts.
    Defined cases: null and empty texts are clean; repeated rows are reported as often as they occur; a replacement mark
    is a lost character.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text rlike '[^\\\\x00-\\\\x7F]'")
    shared = docs.sparkSession.sparkContext.broadcast(char_counts(src))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _of(shared)
        for b in batches:
            keep = [model.garbled(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["doc_id"]).filter(pa.array(keep, pa.bool_()))

    return src.mapInArrow(label, f"doc_id {dict(src.dtypes)['doc_id']}")


def restored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, restored, encoding_pairs, complete) of every garbled text; complete is false where characters were lost or a span could not be restored.

    Defined cases as in garbled_texts. corpus: texts to count characters in, if not these.
    """
    high = lambda df: df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text rlike '[^\\\\x00-\\\\x7F]'")
    src = high(docs)
    shared = docs.sparkSession.sparkContext.broadcast(char_counts(src if corpus is None else high(corpus)))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _of(shared)
        for b in batches:
            ids, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if model.garbled(t):
                    ids.append(k)
                    out.append(model.restore(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array([x[0] for x in out], pa.string()), pa.array(["|".join(x[1]) for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())], names=["doc_id", "restored", "encoding_pairs", "complete"]
            )

    return src.mapInArrow(repair, f"doc_id {dict(src.dtypes)['doc_id']}, restored string, encoding_pairs string, complete boolean")


#: How planted texts are garbled: pairs applied one after the other.
GARBLINGS = {"once": [("utf-8", "cp1252")], "mac": [("utf-8", "mac_roman")], "dos": [("utf-8", "cp437")], "twice": [("utf-8", "latin-1")] * 2, "thrice": [("utf-8", "cp1252")] * 3}


def garble(text: str, pairs: list[tuple[str, str]]) -> str:
    """The text written in one encoding and read in the other, for each pair."""
    for written, read in pairs:
        back = {b: c for c, b in _readings(read).items()}
        text = "".join(chr(b) if b < 128 else back[b] for b in text.encode(written))
    return text


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, garbling, text): every text in each of the ways of GARBLINGS."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for name, pairs in GARBLINGS.items():
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(texts)), pa.array([garble(t, pairs) for t in texts], pa.string())], names=["doc_id", "garbling", "text"])

    src = docs.select("doc_id", "text").where("text is not null")
    return src.mapInArrow(plant, f"doc_id {dict(src.dtypes)['doc_id']}, garbling string, text string")

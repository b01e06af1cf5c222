"""Personal data: exact base patterns, then a semi-Markov conditional random field for what they miss.

The field labels whole segments of up to ``MOST_CHUNKS`` chunks with a kind, or single chunks with none. A chunk is a run of
characters other than white space and separators (``:=,;`` quotes and the like). A segment's score is a weight vector per
kind times features of the whole span (digits, grouping, checksum, separators, spelled-out marks, the words around it),
plus a transition weight from the label before. Dynamic programming over bounded segments picks boundaries and kinds
jointly (chunks of a segment are at most ``MOST_GAP`` white-space characters apart); training maximises the likelihood of seeded, made-up sentences with the same recursion in sums (forward and
backward). Besides the four kinds of the base patterns the field labels secrets (keys, tokens, passwords): ``redact``
replaces them too, the spans of ``find`` hold the four kinds only.

A segment without a digit, ``@`` or spelled-out mark can't have features, so only windows around such chunks are decoded:
twice ``MOST_CHUNKS`` chunks apart no two segments with features can meet, so the result is that of decoding whole texts.
A window may be as long as the text; it is decoded in pieces whose settled labels are those of the whole, for bounded memory.

Base spans always stay: what they cover is closed to the field, and what stands beside them in a chunk is a chunk of its
own. All patterns are scanned in time linear in the text, so very long texts are no special case, and rows are judged one
by one (no shuffle, no groups).

Defined results: a null or empty text has no spans. Repeated rows are judged alike. Columns other than those named pass
through ``redact`` untouched under any name. A null doc_id stays null. An empty table gives an empty result. Offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import heapq
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, release, table

KINDS = ("email", "ip", "card", "phone")
#: What the field labels.
LABELS = (*KINDS, "secret")
#: A segment has so many chunks at most, and so many white-space characters between two of them.
MOST_CHUNKS, MOST_GAP = 12, 8
#: A number has so many chunks with digits at most.
MOST_GROUPS = 7
#: Chunks that are decoded at once, for bounded memory; the result doesn't depend on it.
PIECE = 4096
TRAINING_SENTENCES, EPOCHS, SEED = 1000, 5, 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns, by kind and then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 13 <= len(d := "".join(_DIGIT.findall(m.group()))) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# The field.

_AT, _DOT = r"[(\[{]\s?(?i:at|@)\s?[)\]}]", r"[(\[{]\s?(?i:dot|\.)\s?[)\]}]"
_CHUNK = re.compile(rf"(?:{_AT}|{_DOT}|[^\s:=,;\"'<>|«»“”()\[\]{{}}]+|[()\[\]{{}}])+")
_HAS_AT, _HAS_DOT = re.compile(_AT), re.compile(_DOT)
_HOT = re.compile(r"[0-9@]\S*")
_MARKED = re.compile(rf"{_AT}|{_DOT}")
_BARE_DOT = re.compile(r"(?i)(?<![a-z])dot(?![a-z])")
_NUMBER = re.compile(rf"[(\[{{]*\+?[0-9](?:[0-9().\-–—/_+·\[\]{{}}]|{_DOT})*")
_GAP = re.compile(r"(?i)[-–—./_()·]+|dot")
_EDGES = "\"'«»“”,;:!?<>*#&%$/~^"
_AS_AT = re.compile(rf"(?i)\s*{_AT}\s*|\s+at\s+|\s*@\s*")
_AS_DOT = re.compile(rf"(?i)\s*{_DOT}\s*|\s+dot\s+|\s+\.\s+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.([A-Za-z]{2,12})")
_KEYLIKE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Fixed word lists.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach", "to", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from", "client", "addr", "ping"),
    "card": ("card", "visa", "credit", "payment", "paid", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "number", "telephone", "telefon", "ring", "text", "whatsapp", "dial", "hotline", "ph", "mob"),
    "secret": ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "access", "bearer", "auth", "credential"),
}
OTHER_CUES = ("order", "version", "ref", "id", "isbn", "no", "page", "pages", "pp", "invoice", "price", "total", "year", "serial", "ticket", "sku", "part", "zip", "sum", "value", "lines", "rows", "code", "commit", "sha", "md5")
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "eu", "us", "biz", "dev", "app", "ch", "nl", "jp", "in", "br")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without what only borders on it: punctuation, and brackets where there are none of their other half."""
    span = text[start:end]
    left = _EDGES + "." + ("" if any(x in span for x in ")]}") else "([{")
    right = _EDGES + ".-–" + ("" if any(x in span for x in "([{") else ")]}")
    inner = span.lstrip(left)
    start += len(span) - len(inner)
    return start, start + len(inner.rstrip(right))


def _around(words: list[str], side: str) -> list[str]:
    """Cues of the one or two words beside a span."""
    out = []
    for k, word in enumerate(words):
        plain = re.sub(r"[^\w-]", "", word.lower())
        out += [f"{side}{k}={kind}" for kind, found in CUES.items() if plain in found]
        out += [f"{side}{k}=other"] if plain in OTHER_CUES or word.endswith("#") else []
    return out


def number_features(span: str) -> list[str]:
    """What holds of a span of digits and separators; none, if it can't be personal data."""
    plain = _DOT_ONLY.sub(".", _AS_DOT.sub(".", span))
    digits = "".join(c for c in plain if "0" <= c <= "9")
    groups = re.findall("[0-9]+", plain)
    quads = plain.split(".") if len(groups) == 4 else []
    quad = len(quads) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads)
    if not (7 <= len(digits) <= 19 or quad):
        return []
    shape = re.sub("[0-9]+", lambda m: str(len(m.group())), plain)
    seps = "".join(sorted({c for c in plain if not "0" <= c <= "9"}))
    found = ["bias", f"digits={len(digits)}", f"groups={min(len(groups), 7)}", f"shape={shape[:24]}", f"seps={seps[:5]}", f"sizes={'-'.join(str(len(g)) for g in groups[:7])}", f"first={groups[0][:2] if groups[0][0] == '0' else groups[0][0]}:{len(groups)}", f"longest={max(map(len, groups))}"]
    luhn_ok = 13 <= len(digits) <= 19 and luhn(digits)
    dated = re.search(r"(?<![0-9])(19|20)[0-9]{2}[-/. ](0?[1-9]|1[0-2])[-/. ][0-3]?[0-9](?![0-9])|(?<![0-9])[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](19|20)[0-9]{2}(?![0-9])", plain)
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    checks = {"quad": quad, "defanged": quad and plain != span, "luhn": luhn_ok, "luhn4": luhn_ok and len(groups) > 2 and min(map(len, groups)) >= 4, "noluhn": not luhn_ok, "badluhn": 13 <= len(digits) <= 19 and not luhn_ok, "plus": span.startswith("+"), "area": plain.startswith("(") and ")" in plain, "date": bool(dated), "year": year and len(groups) > 1, "isbn": digits[:3] in ("978", "979") and len(digits) == 13, "solid": len(groups) == 1, "decimal": bool(re.fullmatch(r"[0-9]+\.[0-9]+", plain)), "even": len(groups) > 2 and len({len(g) for g in groups}) == 1, "mixed": len(seps) > 1, "lines": "\n" in span, "wide": "  " in span, "small": max(map(len, groups)) <= 2 and len(groups) > 3, "zero": groups[0][0] == "0", "00": groups[0].startswith("00")}
    return found + [k for k, v in checks.items() if v]


_DOT_ONLY = re.compile(_DOT)


def spelled_features(span: str) -> list[str]:
    """What holds of a spelled-out address; none, if it is none."""
    plain = _AS_DOT.sub(".", _AS_AT.sub("@", span))
    m = _SPELLED.fullmatch(plain)
    if plain == span or not m or ".." in plain or plain[0] in ".-" or ".@" in plain:
        return []
    bare = bool(re.search(r"(?i)\sat\s", span))
    bare_dot = bool(_BARE_DOT.search(_HAS_DOT.sub("", span)))
    if bare and not (bare_dot or _HAS_DOT.search(span)):
        return []
    marks = ["bareat" if bare else "markat", "baredot" if bare_dot else "markdot" if _HAS_DOT.search(span) else "plaindot"]
    return ["spelled", f"end={'known' if m[1].lower() in ENDINGS else 'unknown'}", f"parts={min(plain.count('.') + 1, 5)}", *marks, f"end={m[1].lower() in ENDINGS}:{marks[0]}:{marks[1]}"]


def key_features(span: str) -> list[str]:
    """What holds of one long chunk of letters and digits; none, if it can't be a secret."""
    if not _KEYLIKE.fullmatch(span) or not any(c.isdigit() for c in span) or not any(c.isalpha() for c in span):
        return []
    upper, lower = any(c.isupper() for c in span), any(c.islower() for c in span)
    hexed = re.fullmatch("[0-9a-f]+", span) is not None
    letters = sum(c.isalpha() for c in span) / len(span)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    return ["keylike", f"size={min(len(span) // 4, 12)}", f"case={upper:d}{lower:d}", f"hex={hexed:d}", f"letters={int(letters * 5)}", f"turns={min(turns * 10 // len(span), 5)}", f"prefix={span[:4] if span[:4].isupper() or span[:3] in ('ghp', 'sk-', 'xox') else '-'}", f"dashes={min(span.count('-'), 3)}", f"slash={'/' in span:d}"]


Chunk = tuple[int, int, int]  # start, end, and 1 if it may be part of a segment with features, 0 if not by itself, -1 if a base span covers it


def lattice(text: str, chunks: list[Chunk], before: tuple[str, ...] = (), lead: int = 0) -> dict[tuple[int, int], tuple[int, int, list[str]]]:
    """(first chunk, chunk after the last) -> (start, end, features) of segments that have features.

    ``before``: the words before the first chunk. The first ``lead`` chunks are only looked at; segments are numbered from the one after.
    """
    out: dict[tuple[int, int], tuple[int, int, list[str]]] = {}
    n = len(chunks)
    whole = [text[s:e] for s, e, _ in chunks]
    inner = [text[slice(*trimmed(text, s, e))] if hot >= 0 else "" for s, e, hot in chunks]
    words = [*before, *whole]
    numbers = [hot == 1 and _NUMBER.fullmatch(x) is not None for x, (_, _, hot) in zip(inner, chunks, strict=True)]
    gaps = [hot >= 0 and _GAP.fullmatch(w) is not None or _HAS_DOT.fullmatch(w) is not None for w, (_, _, hot) in zip(whole, chunks, strict=True)]
    count = [sum("0" <= c <= "9" for c in x) if number else 0 for x, number in zip(inner, numbers, strict=True)]
    spaced = [i > 0 and 0 < chunks[i][0] - chunks[i - 1][1] <= MOST_GAP and text[chunks[i - 1][1] : chunks[i][0]].isspace() for i in range(n)]

    def add(i: int, j: int, make) -> None:
        start, end = trimmed(text, chunks[i][0], chunks[j - 1][1])
        found = make(text[start:end])
        if found and (i - lead, j - lead) not in out:
            at = i + len(before)
            left = i > 0 and spaced[i]
            right = j < n and spaced[j]
            beside = {"leftnumber": left and numbers[i - 1], "rightnumber": right and numbers[j], "leftmark": left and (gaps[i - 1] or _MARKED.search(whole[i - 1]) is not None), "rightmark": right and (gaps[j] or _MARKED.match(whole[j]) is not None), "glued": not left and i > 0 and chunks[i - 1][1] == chunks[i][0]}
            cues = _around(words[max(0, at - 2) : at][::-1], "before") + _around(whole[j : j + 1] if right else [], "after")
            kind = found[0]
            out[i - lead, j - lead] = (start, end, found + [k for k, v in beside.items() if v] + cues + [f"{kind}:{c}" for c in cues] + ([f"{kind}:cued"] if any(c.startswith("before") and not c.endswith("other") for c in cues) else [f"{kind}:uncued"]))

    for i in range(lead, n):
        if numbers[i]:
            total = groups = 0
            for j in range(i, min(i + MOST_CHUNKS, n)):
                if not (numbers[j] or gaps[j]) or (j > i and not spaced[j]):
                    break
                total, groups = total + count[j], groups + numbers[j]
                if total > 19 or groups > MOST_GROUPS:
                    break
                if numbers[j] and (total >= 7 or total >= 4 and (j > i or "[" in inner[i] or "(" in inner[i] or "{" in inner[i])):
                    add(i, j + 1, number_features)
        elif chunks[i][2] == 1 and len(inner[i]) >= 16:
            add(i, i + 1, key_features)
    closed = [hot < 0 for _, _, hot in chunks]
    dots = [bool(_HAS_DOT.search(w)) or w.lower() == "dot" for w in whole]
    ats = [w.lower() == "at" or "@" in w or _HAS_AT.search(w) is not None for w in whole]
    for a, w in enumerate(whole):
        bare = w.lower() == "at"
        if closed[a] or not ats[a] or (bare and not any(dots[max(0, a - MOST_CHUNKS) : a + MOST_CHUNKS])):
            continue
        for i in range(a, max(lead - 1, a - MOST_CHUNKS), -1):
            if closed[i] or (i < a and (ats[i] or not spaced[i + 1])):
                break
            for j in range(a + 1, min(i + MOST_CHUNKS, n) + 1):
                if closed[j - 1] or (j - 1 > a and (ats[j - 1] or not spaced[j - 1])):
                    break
                add(i, j, spelled_features)
    return out


def windows(text: str, base: list[tuple[str, int, int]]):
    """(chunks, words before, how many chunks lead, whether it is the window's last piece) of all stretches that may hold segments with features.

    For a piece that isn't the last, how many of its chunks (without those that lead) are settled is sent back to the generator.
    """
    spots = [(m.start() for m in _HOT.finditer(text)), (m.start() for m in _MARKED.finditer(text)) if "(" in text or "[" in text or "{" in text else iter(())]
    if "dot" in text.lower():
        spots.append(m.start() for m in _BARE_DOT.finditer(text))
    spots = heapq.merge(*spots)
    taken = sorted((s, e) for _, s, e in base)
    spot, k = next(spots, None), 0
    recent: collections.deque[Chunk] = collections.deque(maxlen=MOST_CHUNKS + 1)
    window: list[Chunk] = []
    before: tuple[str, ...] = ()
    left = digits = lead = 0
    marked, limit = False, PIECE

    def pieces(start: int, end: int):
        """A run of characters, cut where base spans begin and end."""
        nonlocal k
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        i = k
        while start < end:
            if i >= len(taken) or taken[i][0] >= end:
                yield start, end, 0
                return
            if taken[i][0] > start:
                yield start, taken[i][0], 0
            yield max(start, taken[i][0]), min(end, taken[i][1]), -1
            start = max(start, taken[i][1])
            i += 1

    for m in _CHUNK.finditer(text):
        if spot is None and not window:
            break
        for start, end, closed in pieces(*m.span()):
            hot = 0
            while spot is not None and spot < end:
                hot = 1 if spot >= start or text[start].isdigit() else hot
                spot = next(spots, None)
            if not hot and not closed and start > m.start() and _HOT.search(text, start, end):
                hot = 1  # the trigger was in the base span before it
            chunk = (start, end, closed or hot)
            if chunk[2] == 1:
                if not window:
                    kept = list(recent)
                    extra = max(0, len(kept) - (MOST_CHUNKS - 1))
                    before, window = tuple(text[s:e] for s, e, _ in kept[:extra]), kept[extra:]
                    digits, marked, limit, lead = 0, False, PIECE, 0
                left = 2 * MOST_CHUNKS
                word = text[start:end]
                digits += sum("0" <= c <= "9" for c in word)
                marked = marked or "@" in word or _MARKED.search(word) is not None or word.lower().strip(".,") == "dot" or len(word) >= 16
            if window or chunk[2] == 1:
                window.append(chunk)
                left -= 1
                if not left:
                    if digits >= 7 or marked:
                        yield window, before, lead, True
                    window = []
                elif len(window) - lead >= limit:
                    settled = lead + (yield window, before, lead, False)
                    done = max(0, settled - MOST_CHUNKS)
                    before = tuple(text[s:e] for s, e, _ in window[max(0, done - 2) : done]) if done else before
                    window, lead = window[done:], settled - done
                    limit = max(PIECE, 2 * (len(window) - lead))
            recent.append(chunk)
    if window and (digits >= 7 or marked):
        yield window, before, lead, True


class Field:
    """Weights by feature and label, transitions between labels (0 is outside), and the recursions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS) + 1, len(LABELS) + 1))

    def rows(self, found: list[str]) -> list[int]:
        return [self.index[f] for f in found if f in self.index]

    def scores(self, segments: dict) -> dict[tuple[int, int], np.ndarray]:
        return {k: self.weights[self.rows(v[2])].sum(axis=0) for k, v in segments.items()}

    def decode(self, n: int, scores: dict, first: np.ndarray | None = None, ends: bool = True) -> tuple[list[tuple[int, int, int]], int, np.ndarray]:
        """The best labelling: (first chunk, chunk after the last, label) of its segments, how many chunks it settles, and the scores to go on from.

        ``first`` has the scores by label of what came before. If more is to come (not ``ends``), settled is only what all
        the best labellings share that could still be gone on from.
        """
        best = np.full((n + 1, len(LABELS) + 1), -np.inf)
        best[0] = [0.0] + [-np.inf] * len(LABELS) if first is None else first
        back: dict[tuple[int, int], tuple[int, int]] = {}
        stops: dict[int, list[int]] = {}
        for i, j in sorted(scores):
            stops.setdefault(j, []).append(i)
        entering, through = np.empty_like(best), np.empty(best.shape, np.int64)  # the best way into a label from each place, and the label before
        for j in range(n + 1):
            if j:
                best[j, 0], back[j, 0] = entering[j - 1, 0], (j - 1, int(through[j - 1, 0]))
                for i in stops.get(j, ()):
                    total = entering[i, 1:] + scores[i, j]
                    for y in np.flatnonzero(total > best[j, 1:]).tolist():
                        best[j, y + 1], back[j, y + 1] = total[y], (i, int(through[i, y + 1]))
            come = best[j][:, None] + self.moves
            through[j] = come.argmax(axis=0)
            entering[j] = come.max(axis=0)
        open_ends = {(n, int(best[n].argmax()))} if ends else {(j, int(y)) for j in range(max(0, n - MOST_CHUNKS + 1), n + 1) for y in np.flatnonzero(best[j] > -np.inf)}
        while len(open_ends) > 1:  # the last goes back until all have met, at the start if not before
            last = max(open_ends)
            if not last[0]:
                open_ends = {(0, int(best[0].argmax()))}
                break
            open_ends.remove(last)
            open_ends.add(back[last])
        settled, label = j, y = open_ends.pop()
        going_on = np.where(np.arange(len(LABELS) + 1) == label, best[settled], -np.inf) if settled else best[0]
        out = []
        while j:
            i, x = back[j, y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, x
        return out[::-1], settled, going_on

    def gradient(self, n: int, segments: dict, gold: dict[tuple[int, int], int]) -> tuple[float, dict[tuple[int, int], np.ndarray], np.ndarray]:
        """Log likelihood of the gold segments, and its slopes by segment score and label, and by transition."""
        scores, labels = self.scores(segments), len(LABELS) + 1
        full = {(i, i + 1): np.concatenate([[0.0], scores.get((i, i + 1), np.full(labels - 1, -np.inf))]) for i in range(n)}
        full |= {k: np.concatenate([[-np.inf], s]) for k, s in scores.items() if k[1] > k[0] + 1}
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        stops: list[list[int]] = [[] for _ in range(n + 1)]
        for i, j in full:
            starts[j].append(i)
            stops[i].append(j)
        alpha, beta = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        alpha[0, 0], beta[n] = 0, 0
        entering = np.full((n + 1, labels), -np.inf)
        for j in range(n + 1):
            if j:
                alpha[j] = np.logaddexp.reduce([entering[i] + full[i, j] for i in starts[j]], axis=0)
            entering[j] = np.logaddexp.reduce(alpha[j][:, None] + self.moves, axis=0)
        leaving = np.full((n + 1, labels), -np.inf)
        for i in range(n - 1, -1, -1):
            leaving[i] = np.logaddexp.reduce([full[i, j] + beta[j] for j in stops[i]], axis=0)
            beta[i] = np.logaddexp.reduce(self.moves + leaving[i][None, :], axis=1)
        total = np.logaddexp.reduce(alpha[n])
        by_segment = {}
        for i, j in segments:
            by_segment[i, j] = p = -np.exp(entering[i, 1:] + full[i, j][1:] + beta[j, 1:] - total)
            if (i, j) in gold:
                p[gold[i, j]] += 1
        by_move = -sum(np.exp(alpha[i][:, None] + self.moves + leaving[i][None, :] - total) for i in range(n))
        value, i, last = -total, 0, 0
        ends = {a: (b, k + 1) for (a, b), k in gold.items()}
        while i < n:
            j, y = ends.get(i, (i + 1, 0))
            value += self.moves[last, y] + full[i, j][y]
            by_move[last, y] += 1
            i, last = j, y
        return float(value), by_segment, by_move

    def step(self, n: int, segments: dict, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the likelihood of the gold segments."""
        _, by_segment, by_move = self.gradient(n, segments, gold)
        for k, slope in by_segment.items():
            np.add.at(self.weights, self.rows(segments[k][2]), rate * slope)
        self.moves *= 1 - 0.01 * rate
        self.moves += rate * 0.2 * by_move


# Made-up sentences. A # in a pattern is any digit, N one from 2 to 9, D one from 1 to 9.
PHONES = ["(N##) N##-####", "N##-N##-####", "N##.N##.####", "(N##) N## ####", "N## N## ####", "1-N##-N##-####", "1 (N##) N##-####", "1.N##.N##.####", "N##/N##-####", "(N##)N##-####", "1 N## N## ####"]
PHONES += ["020 #### ####", "07### ######", "07### ### ###", "01## ### ####", "(020) #### ####", "0D### ######", "0D## ### ####", "030 ######", "0D#/#######", "0D##-#######", "0D## #######", "(0D#) #######", "0D## ## ## ##", "0D ## ## ## ##", "0D.##.##.##.##", "0D-##-##-##-##", "04## ### ###", "(0D) #### ####", "03-####-####", "090-####-####", "(DD) 9####-####", "(DD) ####-####", "0D#-########"]
PHONES += ["00DD D ## ## ## ##", "00DD ## #######", "00DD ## ######", "00DD ### ######", "00DD ## #### ####", "00DD-###-#######", "00DD (0)## #### ####", "001 N## N## ####", "001-N##-N##-####", "0D## - N## ####", "N## - N## - ####"]
#: Only with a cue before them.
CUED_PHONES = ["9## ### ###", "6## ### ###", "N#########", "0##########", "00############", "0########", "N##-####", "9## ## ## ##", "9#### #####", "DN# ### ###"]
#: Numbers that are no personal data.
NUMBERS = ["20##-0D-1#", "19##-0D-2#", "1#/0D/20##", "1#.0D.20##", "2#.1#.19##", "20## 0D 1#", "19##-20##", "19## 20## 20##", "D.#.#", "D#.##.#", "D.##.#.##", "D ### ###", "D## ### ###", "D# ### ### ###", "D.###.###", "978-#-##-######-#", "978 # ### ##### #", "979-##-####-###-#", "#-###-#####-#", "###-#######-#######", "D#######", "D########", "20##-00######", "##.#### ##.####", "##.#### -##.####", "D################", "#.##############", "D00000000", "D##-D## D##-D##", "D###-D### D###-D###", "D-D D-D D-D D-D", "00##-####", "#####-####", "###-##-####", "D## D## D## D##", "D# D# D# D# D# D#", "## ## ## ## ## ## ##", "D### D### D###", "D.# D.# D.# D.# D.#", "D#.# D#.# D#.#", "##/## ##/##", "##-##-## ##-##", "D##.## D##.##", "D## #### #", "D D D D D D D D D", "D#### D#### D####", "###### ######", "D##, D##, D##", "D.### D.### D.###", "D## x D## x D##", "20## 20## 20## 20##", "1#:## 1#:##", "D##### D#####", "D### ## ## D", "##/##/## ##/##/##", "D# D## D### D#", "########-####"]
CARDS = ["####.####.####.####", "####/####/####/####", "####_####_####_####", "####–####–####–####", "####·####·####·####", "####  ####  ####  ####", "#### - #### - #### - ####", "####.######.#####", "####/######/#####", "####–######–#####", "####. ####. ####. ####"]


def _filled(rng: random.Random, pattern: str) -> str:
    choice = {"#": "0123456789", "N": "23456789", "D": "123456789"}
    return "".join(rng.choice(choice[c]) if c in choice else c for c in pattern)


def _card(rng: random.Random, good: bool) -> str:
    pattern = rng.choice(CARDS)
    places = [i for i, c in enumerate(pattern) if c == "#"]
    while True:
        digits = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in places[1:])
        if luhn(digits) == good:
            out = list(pattern)
            for i, d in zip(places, digits, strict=True):
                out[i] = d
            return "".join(out)


def _word(rng: random.Random, low: int = 2, high: int = 8) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(low, high)))


def _spelled(rng: random.Random) -> str:
    name = [_word(rng) for _ in range(rng.choice([1, 1, 2]))]
    where = [_word(rng) for _ in range(rng.choice([1, 1, 2]))] + rng.choice([["com"], ["org"], ["net"], ["io"], ["de"], ["fr"], ["edu"], ["co", "uk"]])
    if rng.random() < 0.3:
        name[-1] += str(rng.randint(1, 99))
    if rng.random() < 0.2:
        name, where = [x.title() for x in name], [x.title() for x in where[:-1]] + where[-1:]
    at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " {at} ", "[@]", "(@)", " @ ", " at ", " at ", " AT "])
    dots = [" dot ", " DOT ", " [dot] "] if at.strip().lower() == "at" else [" [dot] ", "[dot]", "(dot)", " (dot) ", ".", ".", "[.]", " dot ", " {dot} "]
    dots = [" . ", " dot ", "."] if at == " @ " else dots
    dot = rng.choice(dots)
    inside = rng.choice([".", "_", dot if "dot" in dot.lower() else "."])
    return inside.join(name) + at + dot.join(where)


def _secret(rng: random.Random) -> str:
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, both = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    form = rng.randrange(5)
    if form == 0:
        return rng.choice(["AKIA", "ASIA"]) + some(upper + "234567", 15) + some("234567", 1)
    value = [some("0123456789abcdef", rng.choice([16, 18, 20, 24, 32, 40, 64])), some(both, rng.randint(20, 40)) + "7a", "ghp_" + some(both, 36) + "1", some(both + "+/", rng.choice([32, 40, 43])) + "9="][form - 1]
    return f"{rng.choice(['token', 'password', 'secret', 'api_key', 'key', 'Token', 'pwd'])}{rng.choice(['=', ' = ', ': '])}" + chr(0) + value


def _sample(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence and the places of all that the field should find in it."""
    made = {
        "email": lambda: _spelled(rng),
        "ip": lambda: rng.choice(["[.]", "[.]", "[dot]", "(.)", "(dot)", " dot ", " [.] ", "{.}", " . "]).join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: _card(rng, True),
        "phone": lambda: _filled(rng, rng.choice(PHONES)),
        "secret": lambda: _secret(rng),
    }
    decoys = [lambda: _filled(rng, rng.choice(NUMBERS)), lambda: _filled(rng, rng.choice(NUMBERS)), lambda: _filled(rng, rng.choice(NUMBERS)), lambda: " ".join(str(rng.randint(0, 10 ** rng.randint(1, 4))) for _ in range(rng.randint(2, 12))), lambda: _card(rng, False), lambda: str(rng.randint(0, 10 ** rng.randint(1, 12))), lambda: f"{_word(rng)} at {_word(rng)}.com", lambda: f"{_word(rng)} at {_word(rng)} dot {_word(rng, 5)}x", lambda: f"the dot {_word(rng)} at {_word(rng)}", lambda: f"commit {hashlib.sha1(_word(rng).encode()).hexdigest()}", lambda: f"{_word(rng)}-{_word(rng)}-{rng.randint(1, 99)}-{_word(rng)}", lambda: f"{hashlib.md5(_word(rng).encode()).hexdigest()}.png", lambda: f"/{_word(rng)}/{_word(rng)}/{rng.randint(1, 9999)}/{_word(rng)}"]
    parts: list[str] = []
    places, at = [], 0

    def put(x: str) -> None:
        nonlocal at
        parts.append(x)
        at += len(x) + 1

    for _ in range(rng.randint(2, 4)):
        for _ in range(rng.randint(1, 4)):
            put(_word(rng))
        if rng.random() < 0.5:
            kind = rng.choice(LABELS)
            cue = rng.choice(CUES[kind]) if rng.random() < 0.4 else None
            what = made[kind]()
            if kind == "phone" and rng.random() < 0.25:
                what, cue = _filled(rng, rng.choice(CUED_PHONES)), rng.choice(CUES["phone"])
            if cue and kind != "secret":
                put(rng.choice([cue, cue.title()]) + rng.choice(["", "", ":", " is"]))
            skip = what.find(chr(0)) + 1
            what = what.replace(chr(0), "")
            start = at + max(0, skip - 1)
            end = at + len(what)
            put(what + rng.choice(["", "", "", ".", ",", "!"]))
            places.append((kind, start, end))
        else:
            if rng.random() < 0.4:
                put(rng.choice(OTHER_CUES))
            put(rng.choice(decoys)())
    return " ".join(parts), places


def _sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence and the places of the personal data in it that are of the four kinds."""
    text, places = _sample(rng)
    return text, [x for x in places if x[0] in KINDS]


@functools.lru_cache
def trained(sentences: int = TRAINING_SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """The field, fitted to seeded made-up sentences (some seconds on the driver; nothing of the corpus is used)."""
    rng, field, data = random.Random(seed), Field(), []
    for _ in range(sentences):
        text, places = _sample(rng)
        covered = base_spans(text)
        places = [p for p in places if not any(s < p[2] and p[1] < e for _, s, e in covered)]
        for chunks, before, _, _ in windows(text, covered):
            segments = lattice(text, chunks, before)
            by_place = {(s, e): k for k, (s, e, _) in segments.items()}
            gold = {by_place[s, e]: LABELS.index(kind) for kind, s, e in places if (s, e) in by_place}
            data.append((len(chunks), segments, gold))
            for _, _, found in segments.values():
                for f in found:
                    field.index.setdefault(f, len(field.index))
    field.weights = np.zeros((len(field.index), len(LABELS)))
    for f in ("bias", "spelled", "keylike"):
        field.weights[field.index[f]] = -1
    field.weights[field.index["noluhn"], LABELS.index("card")] = -5
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segments, gold in data:
            field.step(n, segments, gold, 0.3 / (1 + 0.5 * epoch))
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans of the field, of all its labels; none overlaps a base span."""
    out: list[tuple[str, int, int]] = []
    found = windows(text, base)
    first, piece = None, next(found, None)
    while piece is not None:
        chunks, before, lead, ends = piece
        # Of a piece that goes on, the last chunks are only looked at, as their own surroundings are not known yet.
        n = max(0, len(chunks) - lead - (0 if ends else MOST_CHUNKS))
        segments, settled = lattice(text, chunks, before, lead), n
        if segments or not ends:
            scores = field.scores({k: v for k, v in segments.items() if k[1] <= n})
            labelled, settled, first = field.decode(n, scores, first, ends)
            out.extend((LABELS[y], *segments[i, j][:2]) for i, j, y in labelled)
        first = None if ends else first
        try:
            piece = next(found) if ends else found.send(settled)
        except StopIteration:
            piece = None
    return out


def every_span(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans with secrets), each by kind and start."""
    base = base_spans(text)
    order = lambda x: (LABELS.index(x[0]), x[1], x[2])
    return sorted(base, key=order), sorted({*base, *added_spans(text, base, field)}, key=order)


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans of the four kinds), each by kind and start."""
    base, spans = every_span(text, field)
    return base, [x for x in spans if x[0] in KINDS]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlaps merged, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _found(field: Field, wanted: list[str]):
    def run(batches):
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in RESULTS}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base, every = every_span(text or "", field)
                spans = [x for x in every if x[0] in KINDS]
                row = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans), len(every) - len(spans), redacted(text, every) if text and every else text]
                for c, v in zip(columns.values(), row, strict=True):
                    c.append(v)
            made = [pa.array(columns[n], pa.int64() if n.startswith("n_") else pa.string()) for n in wanted]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + made, [*batch.schema.names[:-1], *wanted])
        release()

    return run


#: What is found in a text: counts of base spans, the digest of the base spans, all spans, their number and that of secrets, the text with all replaced.
RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secrets", "redacted"]


def find(docs: DataFrame, keep: list[str], text: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the ``wanted`` of ``RESULTS`` (all but the redacted text); a kept column with the name of a result is replaced by it."""
    wanted = RESULTS[:-1] if wanted is None else wanted
    keep = [c for c in keep if c not in wanted]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {'long' if n.startswith('n_') else 'string'}" for n in wanted]
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(_found(trained(), wanted), ", ".join(kinds))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` in its own columns, with personal data and secrets in ``text`` replaced by their kind, and ``n_chars`` made right where there is one."""
    sealed = Sealed(docs)
    at = f"in_{sealed.place('text')}"
    out = find(sealed.df, [c for c in sealed.df.columns if c != at], at, ["redacted"]).withColumnRenamed("redacted", at)
    counted = {} if sealed.place("n_chars") is None else {"n_chars": F.coalesce(F.length(at).cast("long"), sealed.of("n_chars"))}
    return sealed.opened(out, counted)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

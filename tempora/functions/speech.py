"""Reading and aligning spoken text, as plain functions of one text.

``tempora.operators.speech`` applies them to columns in Arrow batches.  Texts are handled by code
points; times are seconds.
"""

from __future__ import annotations

import math
import re
import unicodedata

# fixed values: number words
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 1000, "million": 1000_000, "billion": 1000_000_000, "trillion": 1000_000_000_000}
HAN_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_SMALL = {"十": 10, "百": 100, "千": 1000}
HAN_LARGE = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8, "兆": 10**12}
KO_DIGITS = {c: i for i, c in enumerate("영일이삼사오육칠팔구")}
KO_SMALL = {"십": 10, "백": 100, "천": 1000}
KO_LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}

VALUES = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
WORD = re.compile(r"[A-Za-z]+|[^A-Za-z]+")
NOT_LETTERS = re.compile(r"[\W_]+", re.UNICODE)


def primary(lang: str | None) -> str:
    """The language of a tag, lower case."""
    return re.split(r"[-_]", (lang or "").strip().lower())[0]


def letters(text: str) -> str:
    """Lower case, letters and numbers only."""
    return "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LN")


# numbers


def english_digits(text: str) -> str:
    """English number words as digits: cardinals up to trillions, ``and`` after hundreds, decimals after
    ``point``, and ``percent`` behind a number as a sign.  Other text stays as it is."""
    parts = WORD.findall(text)
    out, at = [], 0
    while at < len(parts):
        found = _cardinal(parts, at)
        if found is None:
            out.append(parts[at])
            at += 1
            continue
        value, at = found
        shown = str(value)
        words = _words(parts, at, 1)
        if words and words[0][1] == "point":
            digits, end = "", words[0][0]
            while (nxt := _words(parts, end, 1)) and VALUES.get(nxt[0][1], 10) < 10:
                digits, end = digits + str(VALUES[nxt[0][1]]), nxt[0][0]
            if digits:
                shown, at = f"{shown}.{digits}", end
        words = _words(parts, at, 1)
        if words and words[0][1] in ("percent", "percents"):
            shown, at = shown + "%", words[0][0]
        out.append(shown)
    return "".join(out)


def _words(parts: list[str], at: int, n: int) -> list[tuple[int, str]]:
    """The next n words, if only blanks or hyphens are between, each with the place behind it."""
    out = []
    while len(out) < n and at < len(parts):
        if not parts[at][0].isascii() or not parts[at][0].isalpha():
            if parts[at].strip(" \t\n-"):
                break
        else:
            out.append((at + 1, parts[at].lower()))
        at += 1
    return out


def _cardinal(parts: list[str], at: int) -> tuple[int, int] | None:
    if parts[at].lower() not in VALUES:
        return None
    total, group, last, end = 0, 0, None, at
    while True:
        ahead = _words(parts, end, 2)
        if not ahead:
            break
        place, word = ahead[0]
        if word == "and" and last in ("hundred", "scale") and len(ahead) > 1 and ahead[1][1] in VALUES:
            end, last = place, "and"
            continue
        if word in VALUES:
            value = VALUES[word]
            fits = last in (None, "hundred", "scale", "and") or (last == "tens" and 0 < value < 10)
            if not fits:
                break
            group, last = group + value, "tens" if value >= 20 else "ones"
        elif word == "hundred" and 0 < group < 100 and last in ("ones", "tens"):
            group, last = group * 100, "hundred"
        elif word in SCALES and group and (not total or total >= SCALES[word] * 1000):
            total, group, last = total + group * SCALES[word], 0, "scale"
        else:
            break
        end = place
    return total + group, end


def _positional(run: str, digits: dict[str, int], small: dict[str, int], large: dict[str, int]) -> str:
    """A run of numerals as a number; digits without units are read one by one."""
    if not any(c in small or c in large for c in run):
        return "".join(str(digits[c]) for c in run)
    total = group = 0
    digit = None
    for c in run:
        if c in digits:
            digit = digits[c]
        elif c in small:
            group, digit = group + (1 if digit is None else digit) * small[c], None
        else:
            group += digit or 0
            total, group, digit = total + (group or 1) * large[c], 0, None
    return str(total + group + (digit or 0))


def _numerals(text: str, digits: dict[str, int], small: dict[str, int], large: dict[str, int], least: int) -> str:
    run = re.compile("[" + "".join([*digits, *small, *large]) + "]{" + str(least) + ",}")
    return run.sub(lambda m: _positional(m[0], digits, small, large), text)


def read_numbers(text: str, lang: str | None) -> str:
    """Number words of a language as digits (en, ko, zh, ja; others stay).  Single Chinese, Japanese and
    Korean numerals stay: they are parts of words."""
    kind = primary(lang)
    if kind == "en":
        return english_digits(text)
    if kind == "ko":
        return _numerals(text, KO_DIGITS, KO_SMALL, KO_LARGE, 2)
    return _numerals(text, HAN_DIGITS, HAN_SMALL, HAN_LARGE, 2) if kind in ("zh", "ja") else text


def spell_number(n: int, lang: str) -> str | None:
    """A number as it is read, without blanks (en up to a million, ko); None for others."""
    if lang == "ko":
        if n == 0:
            return "영"
        out = ""
        for name, unit in (("조", 10**12), ("억", 10**8), ("만", 10**4), ("", 1)):
            group, n = divmod(n, unit)
            for small, place in (("천", 1000), ("백", 100), ("십", 10), ("", 1)):
                d = group // place % 10
                out += ("" if d == 1 and small else "영일이삼사오육칠팔구"[d]) + small if d else ""
            out += name if group else ""
        return out
    if lang != "en" or n >= 1000_000:
        return None
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + (ONES[n % 10] if n % 10 else "")
    unit, name = (100, "hundred") if n < 1000 else (1000, "thousand")
    return f"{spell_number(n // unit, lang)}{name}" + (spell_number(n % unit, lang) if n % unit else "")


# scripts and names


def hiragana(text: str) -> str:
    """Katakana letters as hiragana (the same letters, 0x60 code points before)."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def fold_names(text: str, names: list[tuple[str, str]]) -> str:
    """Spoken forms back to how they are written, the longest first, at word ends for ASCII words."""
    for written, spoken in names:
        head = r"(?<![A-Za-z0-9])" if re.match(r"[A-Za-z0-9]", spoken) else ""
        tail = r"(?![A-Za-z0-9])" if re.search(r"[A-Za-z0-9]$", spoken) else ""
        text = re.sub(head + re.escape(spoken) + tail, lambda m, w=written: w, text, flags=re.IGNORECASE)
    return text


def name_folds(*layers: dict[str, str] | None) -> list[tuple[str, str]]:
    """Layers of {written: spoken}, later ones over earlier ones, the longest spoken form first."""
    every: dict[str, str] = {}
    for layer in layers:
        every |= layer or {}
    kept = [(w, s) for w, s in every.items() if w and s and s != w]
    return sorted(kept, key=lambda x: -len(x[1]))


def fold(text: str | None, lang: str | None = None, names: list[tuple[str, str]] = (), han: dict[str, str] | None = None) -> str:
    """NFKC, names as written, one script (``han`` maps characters to those of another script), digits."""
    out = fold_names(unicodedata.normalize("NFKC", text or ""), names)
    kind = primary(lang)
    if kind == "zh" and han:
        out = out.translate(str.maketrans(han))
    out = read_numbers(out, lang)
    return hiragana(out) if kind == "ja" else out


def normal_form(text: str | None, lang: str | None = None, names: list[tuple[str, str]] = (), han: dict[str, str] | None = None) -> str:
    return letters(fold(text, lang, names, han))


# marks


def strip_marks(text: str | None) -> str:
    """Without {marks} and [marks]; single blanks, none before punctuation."""
    out = re.sub(r"\{[^{}]*\}|\[[^\[\]]*\]", " ", text or "")
    return re.sub(r"\s+([,.;:!?…。、，！？])", r"\1", re.sub(r"\s+", " ", out)).strip()


# differences


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def error_rate(target: str | None, heard: str | None, lang: str | None = None, names: list[tuple[str, str]] = ()) -> float:
    a, b = normal_form(target, lang, names), normal_form(heard, lang, names)
    return edit_distance(a, b) / max(1, len(a))


def token_diffs(target: str | None, heard: str | None) -> list[dict[str, str]]:
    """What was wanted and heard instead, word by word: a least alignment, substitutions before
    deletions before insertions from the end, neighbouring differences joined."""
    a, b = (target or "").split(), (heard or "").split()
    x, y = [letters(unicodedata.normalize("NFKC", w)) for w in a], [letters(unicodedata.normalize("NFKC", w)) for w in b]
    cost = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            row.append(cost[i - 1][j - 1] if x[i - 1] == y[j - 1] else 1 + min(cost[i - 1][j - 1], cost[i - 1][j], row[j - 1]))
        cost.append(row)
    i, j, steps = len(a), len(b), []
    while i or j:
        here = cost[i][j]
        if i and j and x[i - 1] == y[j - 1]:
            i, j, step = i - 1, j - 1, None
        elif i and j and here == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            step = (a[i], b[j])
        elif i and here == cost[i - 1][j] + 1:
            i -= 1
            step = (a[i], None)
        else:
            j -= 1
            step = (None, b[j])
        steps.append(step)
    out, run = [], []
    for step in [*reversed(steps), None]:
        if step:
            run.append(step)
        elif run:
            out.append({"want": " ".join(w for w, _ in run if w is not None), "heard": " ".join(h for _, h in run if h is not None)})
            run = []
    return out


def common_pairs(a: str | list[str], b: str | list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as places in both, the earliest that the first text allows."""
    n, m = len(a), len(b)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = length[i], length[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def sentence_ends(target: str | None, heard: str | None, lang: str | None = None, names: list[tuple[str, str]] = ()) -> list[dict]:
    """Of each sentence whether its last letter was heard."""
    parts = [p for p in (normal_form(p, lang, names) for p in re.split(r"[.?!。？！]+(?=\s|$)|[。？！]+", strip_marks(target))) if p]
    met = {i for i, _ in common_pairs("".join(parts), normal_form(heard, lang, names))}
    out, end = [], 0
    for k, p in enumerate(parts, 1):
        end += len(p)
        out.append({"sentence": k, "final": p[-1], "heard": end - 1 in met})
    return out


def compare_line(text: str | None, say: str | None, heard: str | None, lang: str | None = None, names: list[tuple[str, str]] = ()) -> dict:
    """The lesser error rate of the caption and of what was to be said (the caption on a tie), and the differences."""
    tried = [("text", strip_marks(text))] + ([("say", strip_marks(say))] if say is not None else [])
    rates = [(error_rate(v, heard, lang, names), k, v) for k, v in tried]
    rate, key, target = min(rates, key=lambda r: r[0])
    return {"rate": rate, "against": key, "diffs": token_diffs(fold(target, lang, names), fold(heard, lang, names))}


# words in time: (w, start, end)


def match_letters(word: str, lang: str) -> str:
    """Letters of a word as it is read: clock times and numbers spelled out."""
    s = unicodedata.normalize("NFKC", word).lower()

    def read(digits: str) -> str:
        return spell_number(int(digits), lang) or digits if len(digits) < 16 else digits

    def clock(m: re.Match) -> str:
        h, minutes = read(m[1]), int(m[2])
        if lang == "ko":
            return f"{h}시" + (f"{read(m[2])}분" if minutes else "")
        return f"{h} " + (read(str(minutes)) if minutes else "")

    s = re.sub(r"(\d{1,2}):(\d{2})", clock, s)
    return letters(re.sub(r"\d+", lambda m: read(m[0]), s))


def word_shares(words: list[str]) -> list[tuple[float, float]]:
    """Where words lie on [0, 1] by their letters."""
    sizes = [max(1, len(NOT_LETTERS.sub("", w))) for w in words]
    total, at, out = sum(sizes), 0, []
    for n in sizes:
        out.append((at / total, (at + n) / total))
        at += n
    return out


def words_on_caption(text: str | None, timed: list[tuple[str, float, float]], offset: float = 0.0) -> list[tuple[str, float, float]]:
    """Caption words with the times of heard words: one by one if there are as many, else by letters."""
    words = (text or "").split()
    heard = [t for t in timed or [] if t[1] is not None and t[2] is not None]
    if not words or not heard:
        return []
    if len(words) == len(heard):
        return [(w, t[1] + offset, t[2] + offset) for w, t in zip(words, heard, strict=True)]
    spans = word_shares([t[0] for t in heard])

    def time(share: float, opens: bool) -> float:
        if opens:
            i = next((k for k, (_, b) in enumerate(spans) if b > share), len(spans) - 1)
        else:
            i = next((k for k in range(len(spans) - 1, -1, -1) if spans[k][0] < share), 0)
        a, b = spans[i]
        within = min(1.0, max(0.0, (share - a) / (b - a)))
        return heard[i][1] + within * (heard[i][2] - heard[i][1])

    return [(w, time(a, True) + offset, time(b, False) + offset) for w, (a, b) in zip(words, word_shares(words), strict=True)]


def words_from_letters(text: str, starts: list[float | None], ends: list[float | None], base: float) -> list[tuple[str, float, float]]:
    """Words with the times of their first and last letter; those without a time are left out."""
    out = []
    for m in re.finditer(r"\S+", text):
        a = starts[m.start()] if m.start() < len(starts) else None
        b = ends[m.end() - 1] if m.end() <= len(ends) else None
        if a is not None and b is not None:
            out.append((m[0], base + a, base + b))
    return out


def align_words(text: str | None, heard: list[tuple[str, float, float]], lang: str | None = None, offset: float = 0.0) -> tuple[list[tuple[str, float, float]], int]:
    """Caption words timed by heard words, and how many of them were measured.

    Letters of both are aligned by a longest common subsequence.  A word is measured if half of its
    letters are met, within twice its length; its times are those of its first and last met letter.
    Runs of other words share the time between their neighbours by letters."""
    words = (text or "").split()
    spoken = [h for h in heard or [] if h[1] is not None and h[2] is not None]
    if not words or not spoken:
        return [], 0
    lang = primary(lang) or ("ko" if re.search("[가-힣]", text) else "en" if re.search("[A-Za-z]", text) else "")
    own, said = [match_letters(w, lang) for w in words], [match_letters(h[0], lang) for h in spoken]
    of = [i for i, w in enumerate(own) for _ in w]
    place = [(j, k) for j, w in enumerate(said) for k in range(len(w))]
    met: list[list[int]] = [[] for _ in words]
    for i, j in common_pairs("".join(own), "".join(said)):
        met[of[i]].append(j)

    def time(j: int, opens: bool) -> float:
        h, k = place[j]
        _, a, b = spoken[h]
        return a + (k + (0 if opens else 1)) / len(said[h]) * (b - a)

    times: list[tuple[float, float] | None] = []
    reach = -math.inf
    for w, js in zip(own, met, strict=True):
        if w and len(js) >= math.ceil(len(w) / 2) and js[-1] - js[0] + 1 <= 2 * len(w) + 2:
            a, b = max(reach, time(js[0], True)), time(js[-1], False)
            times.append((a, max(a, b)))
            reach = times[-1][1]
        else:
            times.append(None)
    measured = sum(t is not None for t in times)
    at = 0
    while at < len(words):
        if times[at] is not None:
            at += 1
            continue
        end = at
        while end < len(words) and times[end] is None:
            end += 1
        lo = times[at - 1][1] if at else spoken[0][1]
        hi = times[end][0] if end < len(words) else max(lo, spoken[-1][2])
        for k, (a, b) in zip(range(at, end), word_shares(words[at:end]), strict=True):
            times[k] = (lo + a * (hi - lo), lo + b * (hi - lo))
        at = end
    return [(w, a + offset, b + offset) for w, (a, b) in zip(words, times, strict=True)], measured


def align_script(script: list[tuple[str, str]], heard: list[tuple[str, float, float]], lang: str | None = None) -> tuple[list[dict], list[dict]]:
    """Lines (id, text) timed one after another by heard words: each looks at a window of 1.15 times its
    letters and four; a line of which less than half is measured takes no words and is reported."""
    lines, low, at = [], [], 0
    for ident, text in script:
        plain = strip_breaks(text)
        kind = primary(lang)
        need, n, end = math.ceil(sum(len(match_letters(w, kind)) for w in plain.split()) * 1.15) + 4, 0, at
        while end < len(heard) and n < need:
            n += len(match_letters(heard[end][0], kind))
            end += 1
        words, measured = align_words(plain, heard[at:end], lang)
        if not words or measured < math.ceil(len(words) / 2):
            low.append({"id": ident, "measured": measured, "total": len(plain.split())})
            continue
        lines.append({"id": ident, "start": words[0][1], "end": words[-1][2], "words": words, "measured": measured})
        used = sum(1 for h in heard[at:end] if h[1] < words[-1][2] - 1e-6)
        at += max(1, used)
    return lines, low


# captions


def strip_breaks(text: str | None) -> str:
    """Without break marks; single blanks."""
    return " ".join((text or "").replace("|", " ").split())


def is_wide(lang: str | None) -> bool:
    return primary(lang) in ("zh", "ja", "ko")


def rows_of(words: list[str], limit: int, gap: str = " ") -> list[list[int]]:
    """Places of words in rows of at most ``limit`` characters; a longer word is a row of its own."""
    out: list[list[int]] = []
    used = 0
    for k, w in enumerate(words):
        n = len(w) + (len(gap) if out and out[-1] else 0)
        if out and used + n <= limit:
            out[-1].append(k)
            used += n
        else:
            out.append([k])
            used = len(w)
    return out


def caption_pieces(text: str | None, limit: int) -> list[str]:
    """A caption in pieces: at its break marks, and within them in rows of ``limit`` characters."""
    out = []
    for part in (text or "").split("|"):
        words = part.split()
        out += [" ".join(words[k] for k in row) for row in rows_of(words, limit)]
    return out


def caption_breaks(text: str | None, limit: int, context: int = 3) -> list[dict]:
    """The words around each break between two pieces of a caption; one empty row where it isn't broken."""
    pieces = caption_pieces(text, limit)
    rows = [{"before": " ".join(a.split()[-context:]), "after": " ".join(b.split()[:context])} for a, b in zip(pieces, pieces[1:], strict=False)]
    return rows or [{"before": None, "after": None}]


def build_cues(words: list[tuple[str, float, float]], row: int = 42, rows: int = 2, least: float = 0.8) -> list[dict]:
    """Words in time as cues of at most ``rows`` rows; each lasts ``least`` seconds if the next one allows it."""
    lines = rows_of([w[0] for w in words], row)
    cues = []
    for k in range(0, len(lines), rows):
        group = lines[k : k + rows]
        cues.append({"lines": [" ".join(words[i][0] for i in r) for r in group], "start": words[group[0][0]][1], "end": words[group[-1][-1]][2]})
    for cue, nxt in zip(cues, [*cues[1:], None], strict=False):
        cue["end"] = max(cue["end"], cue["start"] + least)
        if nxt and nxt["start"] > cue["start"]:
            cue["end"] = min(cue["end"], nxt["start"])
    return cues


def pack_by_size(sizes: list[int], limit: int) -> list[int]:
    """The group of each item: in order, a new one where the limit would be passed; too large items are alone."""
    out, group, used = [], -1, 0
    for n in sizes:
        if group < 0 or used + n > limit:
            group, used = group + 1, 0
        used += n
        out.append(group)
    return out


def words_to_lines(words: list[str], texts: list[str]) -> list[tuple[int, int]] | None:
    """Which words (from, to) make up each text, by letters; None unless every text ends where a word does."""
    ends, total = {0: 0}, 0
    for k, w in enumerate(words, 1):
        total += len(letters(w))
        ends[total] = k
    if letters("".join(words)) != letters("".join(texts)):
        return None
    out, at, here = [], 0, 0
    for t in texts:
        at += len(letters(t))
        if at not in ends:
            return None
        out.append((here, ends[at]))
        here = ends[at]
    return out

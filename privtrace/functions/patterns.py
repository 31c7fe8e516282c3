"""What every match of a pattern must contain.

A long pattern list is cheap on most texts when a pattern runs only where one of
its required literals occurs: a plain substring search is far faster than a
regular expression. The literals are read off the parsed pattern, so the gate
never changes a result.
"""
from __future__ import annotations

import re
import warnings
from functools import lru_cache

try:  # the parser moved in Python 3.11
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as K
    import sre_parse as parser

MAX_LITERALS = 64
#: A run of word characters this long is rare enough to ask for.
LONG_RUN = 8


def _best(options):
    """The set whose shortest literal is longest; smaller sets win ties."""
    usable = [o for o in options if o and len(o) <= MAX_LITERALS]
    return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _sequence(items):
    options, run = [], ""
    for op, arg in items:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if run:
            options.append({run})
            run = ""
        if op is K.SUBPATTERN:
            options.append(_sequence(arg[-1]))
        elif op is K.BRANCH:
            parts = [_sequence(b) for b in arg[1]]
            if all(parts):
                options.append(set().union(*parts))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            options.append(_sequence(arg[2]))
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            options.append({chr(a) for _, a in arg})
    if run:
        options.append({run})
    return _best(options)


@lru_cache(maxsize=1024)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Strings of which every match holds one (lower-cased); empty when none can be told."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _sequence(parser.parse(pattern))
    except re.error:
        return ()
    return tuple(sorted({x.lower() for x in found})) if found else ()


@lru_cache(maxsize=1024)
def exact_literals(pattern: str) -> tuple[str, ...]:
    """Strings of which every match holds one as it stands; empty when none can be told, or where the pattern sets flags."""
    if "(?" in pattern.replace("(?:", ""):
        return ()
    try:
        found = _sequence(parser.parse(pattern))
    except re.error:
        return ()
    return tuple(sorted(found)) if found else ()


_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_DIGIT = frozenset("0123456789")


def _within(op, arg, kind: frozenset) -> bool | None:
    """Does this item take characters of the kind only? None where it takes no character."""
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return None
    if op is K.LITERAL:
        return chr(arg) in kind
    if op is K.IN:
        for o, a in arg:
            if o is K.LITERAL:
                ok = chr(a) in kind
            elif o is K.RANGE:
                ok = all(chr(x) in kind for x in range(a[0], a[1] + 1)) if a[1] < 128 else False
            else:
                ok = o is K.CATEGORY and (a is K.CATEGORY_DIGIT or (a is K.CATEGORY_WORD and kind is _WORD))
            if not ok:
                return False
        return True
    if op is K.SUBPATTERN:
        return _pure(arg[-1], kind)
    if op is K.BRANCH:
        return all(_pure(b, kind) for b in arg[1])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        return _pure(arg[2], kind)
    return False


def _pure(items, kind) -> bool:
    return all(_within(op, arg, kind) is not False for op, arg in items)


def _shortest(op, arg) -> int:
    if op in (K.LITERAL, K.IN):
        return 1
    if op is K.SUBPATTERN:
        return sum(_shortest(o, a) for o, a in arg[-1])
    if op is K.BRANCH:
        return min(sum(_shortest(o, a) for o, a in b) for b in arg[1])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        return arg[0] * sum(_shortest(o, a) for o, a in arg[2])
    return 0


def _run(items, kind) -> int:
    best = now = 0
    for op, arg in items:
        if _within(op, arg, kind) is not False:
            now += _shortest(op, arg)
            continue
        best, now = max(best, now), 0
        if op is K.SUBPATTERN:
            best = max(best, _run(arg[-1], kind))
        elif op is K.BRANCH:
            best = max(best, min(_run(b, kind) for b in arg[1]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            best = max(best, _run(arg[2], kind))
    return max(best, now)


def _strings(items) -> set[str] | None:
    """All strings the items can match, where these are few."""
    out = {""}
    for op, arg in items:
        if op is K.LITERAL:
            more = {chr(arg)}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            more = {chr(a) for _, a in arg}
        elif op is K.SUBPATTERN:
            more = _strings(arg[-1])
        elif op is K.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            more = set().union(*parts) if all(p is not None for p in parts) else None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and tuple(arg[:2]) == (0, 1):
            more = _strings(arg[2])
            more = more | {""} if more is not None else None
        else:
            more = None
        if more is None or len(out) * len(more) > MAX_LITERALS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _parsed(pattern: str):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return list(parser.parse(pattern))
    except re.error:
        return []


@lru_cache(maxsize=1024)
def required_runs(pattern: str) -> tuple[int, int]:
    """Every match holds so many word characters in a row, and so many digits in a row."""
    items = _parsed(pattern)
    return _run(items, _WORD), _run(items, _DIGIT)


@lru_cache(maxsize=1024)
def required_words(pattern: str) -> tuple[str, ...]:
    """Whole words (lower-cased) of which every match holds one, where the pattern is a list of them between word borders."""
    items = _parsed(pattern)
    border = (K.AT, K.AT_BOUNDARY)
    if len(items) < 3 or items[0] != border or items[-1] != border:
        return ()
    found = _strings(items[1:-1])
    if not found or not all(x and _WORD.issuperset(x) for x in found):
        return ()
    return tuple(sorted({x.lower() for x in found}))


def sql_text(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_word_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {sql_text(w)})" for w in words) + ")" if words else "false"


def gated_sql(pattern: str, lowered: str, value: str, otherwise: str) -> str:
    """SQL text: ``value`` where the lower-cased text holds a required literal, else ``otherwise``."""
    words = required_literals(pattern)
    return f"CASE WHEN {any_word_sql(lowered, words)} THEN {value} ELSE {otherwise} END" if words else value


_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \t\n\x0b\f\r"}


@lru_cache(maxsize=1024)
def python_pattern(pattern: str) -> str:
    """The pattern with the meaning it has in the JVM: classes of ASCII characters only."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            k = pattern[i + 1]
            if k in _CLASSES:
                out.append(_CLASSES[k] if inside else f"[{_CLASSES[k]}]")
            elif k.lower() in _CLASSES and not inside:
                out.append(f"[^{_CLASSES[k.lower()]}]")
            else:
                out.append(c + k)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            # a bracket right behind the opening one is a member
            for k in ("^", "]"):
                if pattern[i + 1:i + 2] == k:
                    out.append(k)
                    i += 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


_TOKEN = re.compile(r"\w+")
_NUMBER = re.compile("[0-9]+")


class Lowered(str):
    """A lower-cased text with what the gates ask of it, worked out once and only if asked."""

    def words(self) -> set[str]:
        if not hasattr(self, "_words"):
            self._words = set(_TOKEN.findall(self))
        return self._words

    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.words()), default=0)
        return self._longest

    def digits(self) -> int:
        if not hasattr(self, "_digits"):
            self._digits = max(map(len, _NUMBER.findall(self)), default=0)
        return self._digits


class Machine:
    """A compiled pattern that looks at a text only if it holds what every match must hold."""

    def __init__(self, pattern: str, flags: str = ""):
        self.literals = required_literals(pattern)
        self.whole = required_words(pattern)
        self.run, self.digits = required_runs(pattern)
        if self.run < LONG_RUN or self.run <= self.digits:
            self.run = 0
        self.compiled = re.compile(flags + python_pattern(pattern))

    def finditer(self, text: str, lowered: str):
        low = lowered if isinstance(lowered, Lowered) else Lowered(lowered)
        if self.whole:
            if low.words().isdisjoint(self.whole):
                return ()
        elif self.literals and not any(w in low for w in self.literals):
            return ()
        if (self.digits and self.digits > low.digits()) or (self.run and self.run > low.longest()):
            return ()
        return self.compiled.finditer(text)


def _heads(items) -> tuple[set[str], bool]:
    """Strings with one of which every match begins, and whether they are all that a match can hold."""
    out = {""}
    for op, arg in items:
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        more, whole = None, True
        if op is K.LITERAL:
            more = {chr(arg)}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            more = {chr(a) for _, a in arg}
        elif op is K.SUBPATTERN:
            more, whole = _heads(arg[-1])
        elif op is K.BRANCH:
            parts = [_heads(b) for b in arg[1]]
            more, whole = set().union(*(p for p, _ in parts)), all(w for _, w in parts)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            found, ends = _heads(arg[2])
            if tuple(arg[:2]) == (0, 1) and ends:
                more = found | {""}
            elif arg[0] >= 1:
                more, whole = found, ends and tuple(arg[:2]) == (1, 1)
        if more is None or len(out) * len(more) > 4 * MAX_LITERALS:
            return out, False
        out = {a + b for a in out for b in more}
        if not whole:
            return out, False
    return out, True


def _first(items) -> frozenset | None:
    """The ASCII characters a match can begin with, upper and lower case alike; None where they cannot be told."""
    for op, arg in items:
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if op is K.SUBPATTERN:
            return _first(arg[-1])
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            return _first(arg[2]) if arg[0] >= 1 else None
        if op is K.BRANCH:
            parts = [_first(b) for b in arg[1]]
            return frozenset().union(*parts) if all(p is not None for p in parts) else None
        if op is K.LITERAL:
            found = {chr(arg)}
        elif op is K.IN and _within(op, arg, _WORD):
            found = {c for c in _WORD if any(
                (o is K.LITERAL and ord(c) == a) or (o is K.RANGE and a[0] <= ord(c) <= a[1])
                or (o is K.CATEGORY and (a is K.CATEGORY_WORD or c in _DIGIT)) for o, a in arg)}
        else:
            return None
        return frozenset(found | {c.lower() for c in found} | {c.upper() for c in found})
    return None


#: Heads that are looked for one by one in a text.
FEW_HEADS = 8
#: Words whose patterns a scanner remembers.
WORDS_KNOWN = 200_000


class Scanner:
    """Matches of many patterns in a text, tried only where they can begin.

    A pattern that opens with a word border and a word character begins at the
    front of a word. What the word tells of the patterns that can begin there is
    remembered, so a text is taken apart once, not once per pattern. A pattern
    that is a whole word has to match the word; of another one the word's front
    has to agree with the strings, or the character, that it begins with.
    Patterns that begin with a few other strings are tried where these stand;
    the rest are searched for, as are all patterns that tell the cases apart, and
    all in texts beyond ASCII.
    """

    def __init__(self, patterns, flags: str = ""):
        self.machines = [Machine(p, flags) for p in patterns]
        self.any_case = "i" in flags  # words are remembered in lower case
        self.known: dict[str, tuple[int, ...]] = {}
        self.whole: list[tuple[int, int, int, object]] = []  # least length, digits in a row, number, test
        self.fronts: dict[str, list[tuple[str, bool, int]]] = {}  # by first character: front, is it the whole word, number
        self.chars: dict[str, list[int]] = {}
        self.heads: list[tuple[int, tuple[str, ...]]] = []
        self.rest: list[int] = []
        for i, (pattern, machine) in enumerate(zip(patterns, self.machines, strict=True)):
            self._sort(i, pattern, machine)

    def _sort(self, i: int, pattern: str, machine: Machine) -> None:
        items = _parsed(pattern)
        border = (K.AT, K.AT_BOUNDARY)
        opened = bool(items) and items[0] == border
        found, _ = _heads(items)
        found = {h.lower() for h in found}
        found = {h for h in found if not any(h != o and h.startswith(o) for o in found)}
        first = _first(items)
        if not self.any_case:
            self.rest.append(i)
        elif machine.whole:
            for w in machine.whole:
                self.fronts.setdefault(w[0], []).append((w, True, i))
        # a look around would miss the word's neighbours
        elif opened and "(?" not in pattern.replace("(?:", "") and len(items) > 2 and items[-1] == border and _run(items[1:-1], _WORD) and _pure(items[1:-1], _WORD):
            run, digits = required_runs(pattern)
            self.whole.append((run, digits, i, machine.compiled.fullmatch))
        elif "" not in found and opened and all(h[0] in _WORD for h in found):
            for h in found:
                front = _TOKEN.match(h).group()
                self.fronts.setdefault(h[0], []).append((front, len(front) < len(h), i))
        elif "" not in found and len(found) <= FEW_HEADS:
            self.heads.append((i, tuple(sorted(found))))
        elif opened and first and first <= _DIGIT:
            for c in first:
                self.chars.setdefault(c, []).append(i)
        else:
            self.rest.append(i)

    def _of(self, word: str) -> tuple[int, ...]:
        """The patterns that can begin at the front of a lower-cased word."""
        digits = 0 if word.isalpha() else max(map(len, _NUMBER.findall(word)), default=0)
        out = {i for run, d, i, test in self.whole if run <= len(word) and d <= digits and test(word)}
        out |= {i for front, alone, i in self.fronts.get(word[0], ()) if (word == front if alone else word.startswith(front))}
        out.update(self.chars.get(word[0], ()))
        if len(self.known) >= WORDS_KNOWN:
            self.known.clear()
        self.known[word] = found = tuple(out)
        return found

    def finditer(self, text: str):
        """(number of the pattern, match), for each pattern in the order of the text."""
        if not text.isascii():
            low = Lowered(text.lower())
            for i, machine in enumerate(self.machines):
                for hit in machine.finditer(text, low):
                    yield i, hit
            return
        low = Lowered(text.lower())
        known, wanted = self.known, {}
        for word in low.words() if self.any_case else ():
            numbers = known.get(word)
            for i in self._of(word) if numbers is None else numbers:
                wanted.setdefault(i, []).append(word)
        places: dict[str, list[int]] = {}
        for i, words in wanted.items():
            at = []
            for word in words:
                if word not in places:
                    places[word] = _fronts(low, word)
                at += places[word]
            yield from self._tried(i, text, sorted(at) if len(words) > 1 else at)
        for i, heads in self.heads:
            at = sorted({p for h in heads if h in low for p in _all(low, h)})
            if at:
                yield from self._tried(i, text, at)
        for i in self.rest:
            for hit in self.machines[i].finditer(text, low):
                yield i, hit

    def _tried(self, i: int, text: str, places):
        match, end = self.machines[i].compiled.match, 0
        for p in places:
            if p >= end and (hit := match(text, p)):
                end = hit.end()
                yield i, hit


def _all(text: str, part: str):
    p = text.find(part)
    while p >= 0:
        yield p
        p = text.find(part, p + 1)


def _fronts(text: str, word: str) -> list[int]:
    """Where the word stands as a whole word."""
    n = len(word)
    return [p for p in _all(text, word) if (not p or text[p - 1] not in _WORD) and text[p + n:p + n + 1] not in _WORD]


@lru_cache(maxsize=16)
def scanner(patterns: tuple[str, ...], flags: str = "") -> Scanner:
    """One scanner per Python worker and list of patterns."""
    return Scanner(patterns, flags)

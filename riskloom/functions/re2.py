"""RE2 patterns as syntax trees: what they require of a text, and the same pattern for java.util.regex.

:func:`parse` reads the RE2 syntax that rules use and refuses the rest with :class:`Refused`, so nothing is ever translated on a
guess. From the tree come

* :func:`to_java`: a pattern that matches the same strings, with RE2's ASCII ``\\b`` and ``\\s``, its dot, its anchors and its case folding;
* :func:`required`: groups of literals, of each of which one occurs (folded) wherever the pattern matches;
* :func:`digit_run`: how many digits in a row every match holds.

The last two are cheap tests that spare the expression itself on most texts. They are derived by one rule for each kind of node, and
only ever lose strength, never a match.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache


class Refused(ValueError):
    """A pattern, or part of one, that isn't translated."""


EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NO_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
BLANK = r"\t\n\f\r "
KELVIN, LONG_S = r"\x{212A}", r"\x{017F}"
#: Beyond these a set of strings, or one of them, isn't followed further.
MOST_STRINGS, LONGEST = 24, 40
#: Groups of literals kept of a pattern.
GROUPS = 3

#: ASCII character classes by name, as ranges.
POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "digit": "09", "lower": "az", "upper": "AZ", "space": "\t\r  ", "word": "09AZ__az", "xdigit": "09AFaf",
    "punct": "!/:@[`{~", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "print": " ~", "graph": "!~", "ascii": "\x00\x7f",
}
#: Letters for control characters.
CONTROL = {"a": "\x07", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\x0b"}
#: Classes of a letter, as ranges; RE2's blanks have no vertical tab.
PERL = {"d": "09", "w": "09AZ__az", "s": "\t\n\f\r  "}


def _ranges(text: str) -> list[tuple[str, str]]:
    return list(zip(text[::2], text[1::2], strict=True))


# -- the tree ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Char(Node):
    char: str
    fold: bool


@dataclass(frozen=True)
class Class(Node):
    """Ranges, and letters of negated classes (``D``, ``S``, ``W``) among them."""

    ranges: tuple[tuple[str, str], ...]
    others: str
    negated: bool
    fold: bool


@dataclass(frozen=True)
class Dot(Node):
    newline: bool


@dataclass(frozen=True)
class Mark(Node):
    """A place without width: ``b``, ``B``, ``A``, ``z``, ``^`` or ``$`` (of a line)."""

    kind: str


@dataclass(frozen=True)
class Cat(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Alt(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Repeat(Node):
    part: Node
    least: int
    most: int | None
    lazy: bool


@dataclass(frozen=True)
class Group(Node):
    part: Node
    captures: bool


@dataclass
class _Reader:
    pattern: str
    at: int = 0
    flags: dict[str, bool] = field(default_factory=lambda: {"i": False, "s": False, "m": False})

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise Refused(f"{self.pattern!r} ends too early")
        self.at += n
        return out

    def refuse(self, what: str):
        raise Refused(f"{what} at {self.at} of {self.pattern!r}")

    def alternatives(self) -> Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            if part is not None:
                parts.append(self.repeated(part))
        return Cat(tuple(parts))

    def repeated(self, part: Node) -> Node:
        c, bounds = self.peek(), None
        if c and c in "*+?":
            self.take()
            bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif c == "{" and (bounds := self.bounds()) is None:
            return part
        if bounds is None:
            return part
        if isinstance(part, Mark):
            self.refuse("a repeated place without width")
        lazy = self.peek() == "?"
        if lazy:
            self.take()
        if self.peek() and (self.peek() in "*+?" or (self.peek() == "{" and self.bounds() is not None)):
            self.refuse("a repetition of a repetition")
        return Repeat(part, *bounds, lazy)

    def bounds(self) -> tuple[int, int | None] | None:
        """``{n}``, ``{n,}`` or ``{n,m}``, or None, and nothing taken, where the brace is a sign like any other."""
        end = self.pattern.find("}", self.at)
        low, comma, high = self.pattern[self.at + 1 : max(end, 0)].partition(",")
        if end < 0 or not (low.isascii() and low.isdigit()) or not (high == "" or (high.isascii() and high.isdigit())):
            return None
        self.at = end + 1
        least, most = int(low), int(high) if high else None if comma else int(low)
        if least > 1000 or (most is not None and (most > 1000 or most < least)):
            self.refuse("a bad repetition")
        return least, most

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return Dot(self.flags["s"])
        if c == "^":
            return Mark("^" if self.flags["m"] else "A")
        if c == "$":
            return Mark("$" if self.flags["m"] else "z")
        if c == "\\":
            return self.escape()
        if c in "*+?":
            self.refuse("nothing to repeat")
        return Char(c, self.flags["i"])

    def escape(self) -> Node:
        if self.peek() == "Q":
            end = self.pattern.find("\\E", self.at)
            text = self.pattern[self.at + 1 : end if end >= 0 else len(self.pattern)]
            self.at = end + 2 if end >= 0 else len(self.pattern)
            if self.peek() and self.peek() in "*+?{":
                self.refuse("a repeated quotation")
            return Cat(tuple(Char(c, self.flags["i"]) for c in text))
        c = self.peek()
        if c and c in "bBAz":
            return Mark(self.take())
        if c and c in "dswDSW":
            self.take()
            return Class(tuple(_ranges(PERL[c.lower()])), "", c.isupper(), self.flags["i"])
        return Char(self.escaped(), self.flags["i"])

    def escaped(self) -> str:
        c = self.take()
        if c in CONTROL:
            return CONTROL[c]
        if c == "x":
            if self.peek() == "{":
                end = self.pattern.find("}", self.at)
                digits, self.at = self.pattern[self.at + 1 : max(end, 0)], end + 1
            else:
                digits = self.take(2)
            try:
                return chr(int(digits, 16))
            except ValueError:
                self.refuse("a bad code point")
        if c.isascii() and c.isalnum():
            self.refuse(f"\\{c}")
        return c

    def group(self) -> Node | None:
        before = dict(self.flags)
        captures = True
        if self.peek() == "?":
            self.take()
            name = "P<" if self.peek(2) == "P<" else "<" if self.peek() == "<" else ""
            if name:
                self.take(len(name))
                if self.peek() and self.peek() in "=!":
                    self.refuse("a look-behind")
                while self.take() != ">":
                    pass
            else:
                captures, on = False, True
                while (c := self.take()) not in ":)":
                    if c == "-" and on:
                        on = False
                    elif c in self.flags:
                        self.flags[c] = on
                    else:
                        self.refuse(f"(?{c}")
                if c == ")":
                    return None  # flags until the end of the enclosing group
        inner = self.alternatives()
        if self.peek() != ")":
            self.refuse("an open group")
        self.take()
        self.flags = before
        return Group(inner, captures)

    def char_class(self) -> Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        ranges: list[tuple[str, str]] = []
        others, first = "", True
        while first or self.peek() != "]":
            first = False
            if self.peek(2) == "[:":
                end = self.pattern.find(":]", self.at)
                name = self.pattern[self.at + 2 : max(end, 0)]
                if name not in POSIX:
                    self.refuse(f"[:{name}:]")
                ranges += _ranges(POSIX[name])
                self.at = end + 2
                continue
            c = self.take()
            if c == "\\":
                kind = self.peek()
                if kind and kind in "dsw":
                    ranges += _ranges(PERL[self.take()])
                    continue
                if kind and kind in "DSW":
                    if self.flags["i"] and kind == "W":
                        self.refuse("case folding of \\W in a class")
                    others += self.take()
                    continue
                c = self.escaped()
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.take()
                high = self.take()
                if high == "\\":
                    high = self.escaped()
                elif high == "[":
                    self.refuse("a bad range")
                if high < c:
                    self.refuse("a bad range")
                ranges.append((c, high))
            else:
                ranges.append((c, c))
        self.take()
        return Class(tuple(ranges), others, negated, self.flags["i"])


@lru_cache(maxsize=4096)
def parse(pattern: str) -> Node:
    reader = _Reader(pattern)
    tree = reader.alternatives()
    if reader.at < len(pattern):
        reader.refuse("an unopened group")
    return tree


# -- Java ----------------------------------------------------------------------------------------------


def _walk(node: Node):
    yield node
    for part in getattr(node, "parts", None) or ([node.part] if hasattr(node, "part") else []):
        yield from _walk(part)


def _cased(low: str, high: str) -> bool:
    """Whether folding changes a range beyond ASCII letters: such ranges are refused, but for those to the last code point."""
    if high < "\x80" or (low <= "\x80" and high == "\U0010ffff"):
        return False
    if low < "\x80" or ord(high) - ord(low) > 4096:
        return True
    return any(chr(c).lower() != chr(c).upper() or chr(c).casefold() != chr(c) for c in range(ord(low), ord(high) + 1))


def _sign(c: str, special: str) -> str:
    if c in special:
        return "\\" + c
    if c < " " or c == "\x7f":
        return f"\\x{{{ord(c):x}}}" if c not in "\t\n\f\r" else {"\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}[c]
    return c


def _char(node: Char) -> str:
    c = node.char
    if node.fold:
        if c >= "\x80" and _cased(c, c):
            raise Refused(f"case folding of {c!r}")
        if c in "kK":
            return f"[{c}{KELVIN}]"
        if c in "sS":
            return f"[{c}{LONG_S}]"
    return _sign(c, "\\.[]{}()*+-?^$|")


def _class(node: Class) -> str:
    if not node.others and node.ranges == tuple(_ranges(PERL["s"])):
        return f"[{'^' if node.negated else ''}{BLANK}]"
    if "S" in node.others and node.negated:
        raise Refused("\\S in a negated class")
    out, extra = [], ""
    for low, high in node.ranges:
        if node.fold and _cased(low, high):
            raise Refused(f"case folding of {low!r} to {high!r}")
        ends = [_sign(c, "\\[]^-&") for c in (low, high)]
        out.append(ends[0] if low == high else "".join(ends) if ord(high) - ord(low) == 1 else "-".join(ends))
        for letter, other in (("k", KELVIN), ("s", LONG_S)):
            if node.fold and other not in extra and any(low <= x <= high for x in (letter, letter.upper())):
                extra += other
    text = "".join(out)
    for kind in node.others:
        text += f"[^{BLANK}]" if kind == "S" else "\\" + kind
    return f"[{'^' if node.negated else ''}{text}{extra}]"


def _may_be_empty(node: Node) -> bool:
    if isinstance(node, (Mark, Cat)):
        return all(map(_may_be_empty, getattr(node, "parts", ())))
    if isinstance(node, Alt):
        return any(map(_may_be_empty, node.parts))
    if isinstance(node, Repeat):
        return node.least == 0 or _may_be_empty(node.part)
    return isinstance(node, Group) and _may_be_empty(node.part)


def _java(node: Node, scoped: bool) -> str:
    if isinstance(node, (Char, Class)):
        text = _char(node) if isinstance(node, Char) else _class(node)
        letters = isinstance(node, Class) or node.char.isalpha()
        return f"(?i:{text})" if scoped and node.fold and letters else text
    if isinstance(node, Dot):
        return "(?s:.)" if node.newline else "."
    if isinstance(node, Mark):
        return {"b": EDGE, "B": NO_EDGE, "A": r"\A", "z": r"\z", "^": r"(?:\A|(?<=\n))", "$": r"(?=\n|\z)"}[node.kind]
    if isinstance(node, Cat):
        return "".join(_java(p, scoped) for p in node.parts)
    if isinstance(node, Alt):
        return "|".join(_java(p, scoped) for p in node.parts)
    if isinstance(node, Group):
        return f"({'' if node.captures else '?:'}{_java(node.part, scoped)})"
    if node.least > 1 and _may_be_empty(node.part):
        # Java gives up counting where a round is empty; written out, the rounds are tried like any other part.
        if node.least > 8:
            raise Refused("a part that may be empty, more than eight times")
        rest = None if node.most is None else node.most - node.least
        once = Group(node.part, False)
        more = () if rest == 0 else (Repeat(once, 0, rest, node.lazy),)
        return _java(Cat((once,) * node.least + more), scoped)
    bounds = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most))
    if bounds is None:
        bounds = f"{{{node.least}}}" if node.least == node.most else f"{{{node.least},{'' if node.most is None else node.most}}}"
    inner = _java(node.part, scoped)
    if isinstance(node.part, (Cat, Alt)):
        inner = f"(?:{inner})"
    return f"{inner}{bounds}{'?' if node.lazy else ''}"


@lru_cache(maxsize=4096)
def to_java(pattern: str) -> str:
    """The pattern for java.util.regex; flags come first, as ``(?d)`` or, where all of it is case-folded, ``(?id)``."""
    tree = parse(pattern)
    folds = {n.fold for n in _walk(tree) if (isinstance(n, Char) and n.char.isalpha()) or (isinstance(n, Class) and _has_letters(n))}
    mixed = len(folds) > 1
    return ("(?id)" if folds == {True} else "(?d)") + _java(tree, mixed)


def _has_letters(node: Class) -> bool:
    return any(chr(c).isalpha() for low, high in node.ranges for c in range(ord(low), min(ord(high), 0x17F) + 1))


# -- what a match holds --------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Held:
    """``exact``: all strings a node can match, if few; ``groups``: of each one string is in every match."""

    exact: frozenset[str] | None
    groups: tuple[frozenset[str], ...] = ()

    def best(self) -> frozenset[str] | None:
        own = self.groups + ((self.exact,) if self.exact and "" not in self.exact else ())
        return min(own, key=rarity, default=None)


def rarity(group: frozenset[str]) -> float:
    """An estimate of how often some literal of the group turns up; letters count more than signs."""
    return sum(0.08 ** min(len(s), 6) if s.isalnum() else 0.05 ** min(len(s), 6) for s in group)


def _few(strings: set[str]) -> frozenset[str] | None:
    return frozenset(strings) if len(strings) <= MOST_STRINGS and all(len(s) <= LONGEST for s in strings) else None


def _folded(c: str) -> str | None:
    """A character as it is in the folded text; beyond ASCII it isn't followed."""
    return c.lower() if c < "\x80" else None


def _sequence(parts: list[_Held]) -> _Held:
    groups: list[frozenset[str]] = []
    run: frozenset[str] | None = frozenset([""])
    whole = True
    for part in parts:
        groups += part.groups
        longer = _few({a + b for a in run for b in part.exact}) if part.exact is not None else None
        if longer is not None:
            run = longer
            continue
        whole = False
        if "" not in run:
            groups.append(run)
        run = part.exact if part.exact is not None else frozenset([""])
    if whole:
        return _Held(run, tuple(groups))
    if "" not in run:
        groups.append(run)
    return _Held(None, tuple(groups))


def _held(node: Node) -> _Held:
    if isinstance(node, Char):
        c = _folded(node.char)
        return _Held(None if c is None else frozenset([c]))
    if isinstance(node, Class):
        size = sum(ord(high) - ord(low) + 1 for low, high in node.ranges)
        if node.negated or node.others or size > 8 or any(high >= "\x80" for _, high in node.ranges):
            return _Held(None)
        return _Held(frozenset(chr(c).lower() for low, high in node.ranges for c in range(ord(low), ord(high) + 1)))
    if isinstance(node, Dot):
        return _Held(None)
    if isinstance(node, Mark):
        return _Held(frozenset([""]))
    if isinstance(node, Group):
        return _held(node.part)
    if isinstance(node, Cat):
        return _sequence([_held(p) for p in node.parts])
    if isinstance(node, Alt):
        each = [_held(p) for p in node.parts]
        if all(h.exact is not None for h in each) and (union := _few(set().union(*(h.exact for h in each)))) is not None:
            return _Held(union)
        best = [h.best() for h in each]
        return _Held(None, () if any(b is None for b in best) else (frozenset().union(*best),))
    inner = _held(node.part)
    if node.least == 0:
        return _Held(inner.exact | {""} if inner.exact is not None and node.most == 1 else None)
    if node.least == node.most and node.least <= 8:
        return _sequence([inner] * node.least)
    once = _sequence([inner] * min(node.least, 2))
    return _Held(None, once.groups + ((once.exact,) if once.exact and "" not in once.exact else ()))


def _least(group: frozenset[str]) -> frozenset[str]:
    """Without strings that hold another of the group."""
    return frozenset(s for s in group if not any(t != s and t in s for t in group))


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of literals in folded form (lower case, long s as s), the rarest group first; of each every match holds one."""
    held = _held(parse(pattern))
    groups = {_least(g) for g in (*held.groups, *((held.exact,) if held.exact and "" not in held.exact else ())) if "" not in g}
    groups = {g for g in groups if rarity(g) < 0.5 and not any(s.isspace() for s in g)}
    best = sorted(groups, key=lambda g: (rarity(g), sorted(g)))
    kept: list[frozenset[str]] = []
    for g in best:  # a group that another, kept one implies says nothing more
        if not any(all(any(s in t for s in g) for t in k) for k in kept):
            kept.append(g)
    return tuple(tuple(sorted(g)) for g in kept[:GROUPS])


@dataclass(frozen=True)
class _Run:
    """Digits at least: at the beginning, at the end, anywhere in a row; ``all``: nothing but ``size`` digits or more."""

    start: int = 0
    end: int = 0
    best: int = 0
    all: bool = False


def _runs(node: Node) -> _Run:
    if isinstance(node, Char):
        return _Run(1, 1, 1, True) if node.char in "0123456789" else _Run()
    if isinstance(node, Class):
        digits = not node.negated and not node.others and all("0" <= low and high <= "9" for low, high in node.ranges)
        return _Run(1, 1, 1, True) if digits else _Run()
    if isinstance(node, Dot):
        return _Run()
    if isinstance(node, Mark):
        return _Run(all=True)
    if isinstance(node, Group):
        return _runs(node.part)
    if isinstance(node, Cat):
        out = _Run(all=True)
        for part in node.parts:
            r = _runs(part)
            out = _Run(out.best + r.start if out.all else out.start, r.best + out.end if r.all else r.end, max(out.best, r.best, out.end + r.start), out.all and r.all)
        return out
    if isinstance(node, Alt):
        each = [_runs(p) for p in node.parts]
        return _Run(min(r.start for r in each), min(r.end for r in each), min(r.best for r in each), all(r.all for r in each))
    r = _runs(node.part)
    if r.all:
        return _Run(node.least * r.best, node.least * r.best, node.least * r.best, True)
    if not node.least:
        return _Run()
    return _Run(r.start, r.end, max(r.best, r.start + r.end if node.least > 1 else 0), False)


@lru_cache(maxsize=4096)
def digit_run(pattern: str) -> int:
    """Digits in a row that every match holds."""
    return _runs(parse(pattern)).best

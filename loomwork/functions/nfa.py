"""Regular expressions that match in time linear in the text: literals . * + ? | ( ) [ ] and escapes.

A pattern becomes a set of position sets (the construction by first, last and follow positions), so there are no empty
moves; a text is matched by carrying the set of positions that are alive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Pattern:
    def __init__(self, pattern: str):
        self.text, self.at, self.sets, self.follow = pattern, 0, [], []
        self.empty, self.first, self.last = self._either()
        if self.at < len(pattern):
            raise ValueError(f"unmatched ) at {self.at}")

    def _look(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        empty, first, last = self._sequence()
        while self._look() == "|":
            self.at += 1
            e, f, g = self._sequence()
            empty, first, last = empty or e, first | f, last | g
        return empty, first, last

    def _sequence(self):
        empty, first, last = True, frozenset(), frozenset()
        while self._look() and self._look() not in "|)":
            e, f, g = self._repeated()
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | g if e else g
            empty = empty and e
        return empty, first, last

    def _repeated(self):
        empty, first, last = self._atom()
        sign = self._look()
        if sign and sign in "*+?":
            self.at += 1
            if self._look() and self._look() in "*+?":
                raise ValueError(f"stacked quantifiers at {self.at}: lazy and possessive forms are not regular")
            if sign != "?":
                for p in last:
                    self.follow[p] |= first
            empty = empty or sign != "+"
        return empty, first, last

    def _atom(self):
        c = self._look()
        if c in "*+?":
            raise ValueError(f"nothing to repeat at {self.at}")
        self.at += 1
        if c == "(":
            inner = self._either()
            if self._look() != ")":
                raise ValueError("a ( is not closed")
            self.at += 1
            return inner
        if c == "[":
            return self._place(*self._class())
        if c == ".":
            return self._place(frozenset("\n"), True)
        if c == "\\":
            if not self._look():
                raise ValueError("a pattern ends with a backslash")
            c = self._look()
            self.at += 1
        return self._place(frozenset(c), False)

    def _class(self):
        negated = self._look() == "^"
        self.at += negated
        members, first, last = set(), True, None
        while first or self._look() != "]":
            c = self._look()
            if not c:
                raise ValueError("a [ is not closed")
            self.at += 1
            first = False
            if c == "\\":
                c = self._look()
                if not c:
                    raise ValueError("a [ is not closed")
                self.at += 1
            elif c == "-" and last is not None and self._look() not in ("]", ""):
                high = self._look()
                self.at += 1
                members |= {chr(x) for x in range(ord(last), ord(high) + 1)}
                last = None
                continue
            members.add(c)
            last = c
        self.at += 1
        return frozenset(members), negated

    def _place(self, members: frozenset, negated: bool):
        p = len(self.sets)
        self.sets.append((members, negated))
        self.follow.append(set())
        return False, frozenset([p]), frozenset([p])

    def fullmatch(self, text: str) -> bool:
        if not text:
            return self.empty
        alive, after = set(self.first), set()
        for i, c in enumerate(text):
            hit = [p for p in alive if (c in self.sets[p][0]) != self.sets[p][1]]
            if not hit:
                return False
            if i + 1 == len(text):
                return any(p in self.last for p in hit)
            after = set()
            for p in hit:
                after |= self.follow[p]
            alive = after
        return False


def fullmatch(pattern: str, text: str) -> bool:
    return Pattern(pattern).fullmatch(text)


def full_match(c: Column, pattern: str) -> Column:
    """Whether the text matches as a whole; null for null. The pattern is compiled once, here, and refused here."""
    compiled = Pattern(pattern)

    @F.arrow_udf(T.BooleanType())
    def matched(x):
        import pyarrow as pa

        return pa.array([None if t is None else compiled.fullmatch(t) for t in x.to_pylist()], pa.bool_())

    return matched(c)

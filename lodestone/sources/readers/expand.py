"""COPY expansion with replacement. Tokens from a copybook keep its file, line and column."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.sources.readers.cobol import Tokens, named
from lodestone.sources.readers.lexer import PSEUDO, WORD, Line, Token, normalize, tokenize

#: Nested copies that are followed.
MOST_DEPTH = 20
SYSTEM_INCLUDES = ("SQLCA", "SQLDA")


def member_tokens(text: str, file: str) -> list[Token]:
    _, lines, _ = normalize(text.splitlines())
    return [t._replace(file=file) for t in tokenize(lines)[0]]


class Pair:
    """One REPLACING pair: tokens for tokens, or part of a word."""

    def __init__(self, old: Token, new: Token, mode: str | None) -> None:
        self.old, self.new = self.spelled(old), self.spelled(new)
        tag = len(self.old) == 1 and self.old[0].kind == WORD and len(self.old[0].value) > 2 and self.old[0].value[0] == self.old[0].value[-1] == ":"
        self.mode = mode or ("ANYWHERE" if tag else None)
        self.shown = {"from": old.shown(), "to": new.shown()} | ({"mode": mode} if mode else {})

    @staticmethod
    def spelled(t: Token) -> list[Token]:
        return tokenize([Line(t.line, t.value)])[0] if t.kind == PSEUDO else [t]

    def apply(self, tokens: list[Token], k: int) -> tuple[list[Token], int] | None:
        """What takes the place of the tokens from k on, and how many they are; None where the pair doesn't match."""
        at = tokens[k]
        if self.mode:
            if at.kind != WORD or len(self.old) != 1:
                return None
            old, new = self.old[0].value, self.new[0].value if self.new else ""
            value = at.value
            if self.mode == "LEADING":
                value = new + value.removeprefix(old) if value.startswith(old) else value
            elif self.mode == "TRAILING":
                value = value.removesuffix(old) + new if value.endswith(old) else value
            else:
                value = value.replace(old, new)
            return ([at._replace(value=value)], 1) if value != at.value else None
        n = len(self.old)
        if n and [(t.kind, t.value) for t in tokens[k : k + n]] == [(t.kind, t.value) for t in self.old]:
            return [t._replace(line=at.line, column=at.column, file=at.file) for t in self.new], n
        return None


def replace(tokens: list[Token], pairs: list[Pair]) -> list[Token]:
    out: list[Token] = []
    k = 0
    while k < len(tokens):
        hit = next((h for p in pairs if (h := p.apply(tokens, k))), ([tokens[k]], 1))
        out += hit[0]
        k += hit[1]
    return out


class Expander:
    """Expands one program. member gives a copybook's (file, tokens), or None."""

    def __init__(self, member: Callable[[str], tuple[str, list[Token]] | None]) -> None:
        self.member = member
        self.log: list[dict] = []

    def __call__(self, tokens: list[Token], stack: tuple[str, ...] = ()) -> list[Token]:
        t, out, k = Tokens(tokens), [], 0
        division = None
        while k < len(t):
            if t[k].word("DATA", "PROCEDURE", "ENVIRONMENT") and t[k + 1].word("DIVISION"):
                division = t[k].value
            if t[k].word("COPY") and named(t[k + 1]):
                name, pairs, after = self.statement(t, k)
                out += self.insert(name, "COPY", pairs, t[k], stack, division)
                k = after
            elif t[k].word("EXEC") and t[k + 1].word("SQL") and t[k + 2].word("INCLUDE") and t[k + 3].kind == WORD:
                name, after = t[k + 3].value, t.until(k, "END-EXEC") + 1
                if name in SYSTEM_INCLUDES or self.member(name) is None:
                    self.note(name, "SQL_INCLUDE", "system" if name in SYSTEM_INCLUDES else "missing", t[k], len(stack), division, [])
                    out += t.all[k:after]
                else:
                    out += self.insert(name, "SQL_INCLUDE", [], t[k], stack, division)
                k = after
            else:
                out.append(t[k])
                k += 1
        return out

    @staticmethod
    def statement(t: Tokens, k: int) -> tuple[str, list[Pair], int]:
        name, end, pairs = t[k + 1].value.strip().upper(), t.until(k, mark="."), []
        at = t.until(k + 2, "REPLACING")
        if at > k + 5 or at > end:  # the word belongs to a later statement
            k += 2 + 2 * t[k + 2].word("OF", "IN")
            k += t[k].word("SUPPRESS")
            return name, pairs, k + t[k].mark(".")
        at += 1
        while at < end:
            mode = t[at].value if t[at].word("LEADING", "TRAILING") else None
            at += mode is not None
            if t[at + 1].word("BY") and at + 2 < len(t):
                pairs.append(Pair(t[at], t[at + 2], mode))
                at += 3
            else:
                at += 1
        return name, pairs, end + 1

    def note(self, name: str, kind: str, status: str, at: Token, depth: int, division: str | None, pairs: list[Pair]) -> None:
        self.log.append({"member": name, "kind": kind, "status": status, "at_file": at.file, "at_line": at.line, "depth": depth, "division": division, "replacing": [f"{p.shown['from']} BY {p.shown['to']}" for p in pairs]})

    def insert(self, name: str, kind: str, pairs: list[Pair], at: Token, stack: tuple[str, ...], division: str | None) -> list[Token]:
        found = self.member(name)
        status = "missing" if found is None else "recursive" if name in stack else "too_deep" if len(stack) >= MOST_DEPTH else "expanded"
        self.note(name, kind, status, at, len(stack), division, pairs)
        return self(replace(found[1], pairs), (*stack, name)) if status == "expanded" else []



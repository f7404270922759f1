"""Source text with comments and literals blanked out, and the depth of braces at any place."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\])*"'
#: What is not code, by language; strings keep their quotes.
LITERALS = {
    "TypeScript": re.compile(rf"{_C}|{_QUOTED}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "Go": re.compile(rf"{_C}|{_QUOTED}|`[^`]*`|'(?:\\.|[^'\\\n])+'", re.S),
    "Rust": re.compile(rf"""{_C}|b?r(#*)".*?"\1|b?{_QUOTED}|b?'(?:\\[^\n]{{1,8}}?|[^'\\\n])'""", re.S),
    "Php": re.compile(rf"{_C}|#(?!\[)[^\n]*|<<<[ \t]*(['\"]?)(\w+)\1\n.*?\n[ \t]*\2\b|{_QUOTED}|'(?:\\.|[^'\\])*'", re.S),
}


def _blank(m: re.Match) -> str:
    text = m[0]
    if text[0] in "\"'`" and len(text) > 1:
        return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1]
    return re.sub(r"[^\n]", " ", text)


@dataclass
class Code:
    """`text` as written, `bare` of the same length without comments and literal contents."""

    text: str
    bare: str
    _lines: list[int] = field(default_factory=list)
    _braces: list[int] = field(default_factory=list)
    _depths: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, data: bytes | str, language: str) -> Code:
        text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
        bare = LITERALS[language].sub(_blank, text)
        out = cls(text, bare, [m.end() for m in re.finditer("\n", text)])
        depth = 0
        for m in re.finditer("[{}]", bare):
            depth = max(depth + (1 if m[0] == "{" else -1), 0)
            out._braces.append(m.start())
            out._depths.append(depth)
        return out

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at) + 1

    def depth(self, at: int) -> int:
        k = bisect_right(self._braces, at - 1)
        return self._depths[k - 1] if k else 0

    def block(self, at: int) -> tuple[int, int]:
        """The inside of the first braces from `at` on; empty if a `;` comes first or there are none."""
        m = re.compile(r"[{;]").search(self.bare, at)
        if not m or m[0] == ";":
            return at, at
        return m.end(), self.close(m.start())

    def close(self, at: int) -> int:
        """Where the bracket at `at` closes (or the end)."""
        pairs = {"{": "}", "(": ")", "[": "]", "<": ">"}
        start, end = self.bare[at], pairs[self.bare[at]]
        depth = 0
        for m in re.compile(f"[{re.escape(start + end)}]").finditer(self.bare, at):
            if m[0] == ">" and self.bare[m.start() - 1] in "=-":
                continue
            depth += 1 if m[0] == start else -1
            if not depth:
                return m.start()
        return len(self.bare)

    def quoted(self, at: int) -> str:
        """The contents of the literal whose quote stands at `at`."""
        end = self.bare.find(self.bare[at], at + 1)
        return self.text[at + 1 : end if end > 0 else at + 1]


def split_top(text: str, separators: str = ",") -> list[tuple[int, str]]:
    """Pieces between separators that are outside all brackets, with their places."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{<":
            depth += 1
        elif ch in ")]}" or ch == ">" and i and text[i - 1] not in "=-":
            depth = max(depth - 1, 0)
        elif ch in separators and not depth:
            out.append((start, text[start:i]))
            start = i + 1
    out.append((start, text[start:]))
    return [(i, x) for i, x in out if x.strip()]

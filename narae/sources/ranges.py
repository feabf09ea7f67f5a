"""Prose ranges of a document by source kind: what of a text is linted.

Plain text counts whole, Markdown without code, link targets and autolinks, program text by its
comments alone. Identifiers (addresses, paths, file names, tags) are taken out of what is left.
Offsets are code points, half-open.
"""

from __future__ import annotations

import re

#: White space in the Unicode sense (the pattern language's own class has four more characters).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spellings of a source kind.
KINDS = {"plain_text": "plain", "markdown": "markdown", "python": "python", "rust": "rust", "java_script": "script", "javascript": "script", "type_script": "script", "typescript": "script"}

Range = tuple[int, int]

_TOKEN = re.compile(f"[^{WHITE}]+")
_BLANKS = frozenset(WHITE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B)))))
#: What a token must have somewhere to be an identifier; its last stop does not count.
_MARK = re.compile(f"[@/\\\\#]|\\.(?=[^{WHITE}])|www\\.")
_OPENERS = "\"'()[]{}<>“”‘’"
_CLOSERS = _OPENERS + ".,!?;:"
_FILE_NAME = re.compile(r".+\.[A-Za-z0-9_-]{1,63}[가-힣]*", re.DOTALL)


def is_identifier(token: str, tags: bool) -> bool:
    """Whether a token, its wrapping quotes and stops taken off, names something."""
    if any(mark in token for mark in ("://", "@", "/", "\\")) or token.startswith("www."):
        return True
    return bool(_FILE_NAME.fullmatch(token)) or tags and len(token) > 1 and token[0] == "#"


def without_identifiers(text: str, ranges: list[Range], tags: bool) -> list[Range]:
    out = []
    for start, end in ranges:
        done = start
        while m := _MARK.search(text, done, end):
            begin = m.start()
            while begin > done and text[begin - 1] not in _BLANKS:
                begin -= 1
            done = _TOKEN.match(text, begin, end).end()
            token = text[begin:done].lstrip(_OPENERS)
            begin = done - len(token)
            token = token.rstrip(_CLOSERS)
            if token and is_identifier(token, tags):
                out.append((start, begin))
                start = begin + len(token)
        out.append((start, end))
    return [r for r in out if r[0] < r[1]]


# --- Markdown --------------------------------------------------------------------------------

_FENCE = re.compile(r"(`{3,}|~{3,})(.*)", re.DOTALL)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{0,31}:")
_SPECIAL = re.compile(r"!\[|<|\]\(|`+")


def _indent(line: str) -> tuple[int, str]:
    """Columns of leading blanks, with tab stops of four, and what follows."""
    body = line.lstrip(" \t")
    return len(line[: len(line) - len(body)].expandtabs(4)), body


def _link_end(line: str, at: int) -> int:
    """After the parenthesis that closes the one at ``at``; -1 if the line ends before."""
    depth = 0
    while at < len(line) and line[at] not in "\r\n":
        depth += {"(": 1, ")": -1}.get(line[at], 0)
        at += 2 if line[at] == "\\" else 1
        if not depth:
            return at
    return -1


def markdown_ranges(text: str) -> list[Range]:
    out: list[Range] = []
    fence = ""
    span = 0  # width of the backtick run that opened a code span
    start = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        body = re.sub(r"\r?\n$|\r$", "", line) if line.endswith("\n") else line.removesuffix("\r")
        columns, rest = _indent(body)
        if not span and fence:
            closing = len(rest) - len(rest.lstrip(fence[0]))
            if columns <= 3 and closing >= len(fence) and not rest[closing:].strip(" \t"):
                fence = ""
        elif not span and columns <= 3 and (m := _FENCE.match(rest)) and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif span or columns < 4:
            span = _prose_of_line(line, start, span, out)
        start += len(line)
    return [r for r in out if r[0] < r[1]]


def _prose_of_line(line: str, start: int, span: int, out: list[Range]) -> int:
    """Adds a line's prose and returns the width of the code span that is open at its end."""
    prose, at = (-1 if span else 0), 0
    while m := _SPECIAL.search(line, at):
        mark, at = m.group(), m.end()
        if mark[0] == "`":
            before = line[: m.start()]
            if not span and (len(before) - len(before.rstrip("\\"))) % 2:
                at = m.start() + 1  # an escaped backtick; the others of its run may still open a span
            elif not span:
                out.append((start + prose, start + m.start()))
                span, prose = len(mark), -1
            elif len(mark) == span:
                span, prose = 0, at
        elif span:
            at = m.start() + 1
        elif mark == "![":
            out.append((start + prose, start + m.start()))
            prose = at = m.start() + 1
        elif mark == "](":
            out.append((start + prose, start + m.start() + 1))
            prose = at = _link_end(line, m.start() + 1)
            if at < 0:
                return span
        elif _AUTOLINK.match(line, m.start()):
            out.append((start + prose, start + m.start()))
            prose = at = line.find(">", m.start()) + 1
            if not at:
                return span
    if not span:
        out.append((start + prose, start + len(line)))
    return span


# --- programs --------------------------------------------------------------------------------

_PYTHON = re.compile(
    r'"""(?:\\.|(?!""").)*?"""|\'\'\'(?:\\.|(?!\'\'\').)*?\'\'\'|"(?!"")(?:\\.|[^"\\\r\n])*"|\'(?!\'\')(?:\\.|[^\'\\\r\n])*\'|(?P<comment>#[^\r\n]*)|(?P<open>["\'])',
    re.DOTALL,
)
_RUST = re.compile(
    r'b?r(?P<hash>#*)"(?:.*?"(?P=hash)|(?P<open1>))|"(?:(?:\\.|[^"\\])*"|(?P<open2>))|\'(?:[A-Za-z_]\'|(?=[A-Za-z_])|(?:\\u\{[^}]*\}|\\x..|\\[^ux]|\\u(?!\{)|[^A-Za-z_\\])\'|(?P<open3>))'
    r"|(?P<comment>//[^\r\n]*)|(?P<block>/\*)",
    re.DOTALL,
)
_NEST = re.compile(r"/\*|\*/")


def python_ranges(text: str) -> list[Range]:
    """Comments. A string that does not end ends the scan."""
    out = []
    for m in _PYTHON.finditer(text):
        if m.lastgroup == "open":
            break
        if m.lastgroup == "comment":
            out.append(m.span())
    return out


def rust_ranges(text: str) -> list[Range]:
    """Line comments and nested block comments. A literal that does not end ends the scan."""
    out, at = [], 0
    while m := _RUST.search(text, at):
        if any(m[g] is not None for g in ("open1", "open2", "open3")):
            break
        at = m.end()
        if m["comment"] is not None:
            out.append(m.span())
        elif m["block"] is not None:
            depth = 1
            while depth and (n := _NEST.search(text, at)):
                depth += 1 if n.group() == "/*" else -1
                at = n.end()
            at = len(text) if depth else at
            out.append((m.start(), at))
    return out


_SCRIPT = re.compile(
    r"(?P<line>//[^\r\n]*)|(?P<block>/\*)|(?P<string>\"(?:\\.|[^\"\\\r\n])*\"|'(?:\\.|[^'\\\r\n])*')|(?P<open>[\"'])|(?P<tick>`)"
    r"|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<double>\+\+|--)|(?P<assign>/=)|(?P<slash>/)"
    r"|(?P<parens>[()])|(?P<brace>[{}])|(?P<value>[\].])|(?P<operator>[-+\[,;:?=!~*%&|^<>])",
    re.DOTALL | re.ASCII,
)
_REGEX = re.compile(r"/(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])*/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
# Words after which a slash begins a regular expression; words whose parentheses an expression follows.
_BEFORE_VALUE = frozenset("await case default delete do else extends in instanceof new of return throw typeof void yield".split())
_CONTROL = frozenset("catch for if switch while with".split())


def script_ranges(text: str) -> list[Range]:
    """Comments of JavaScript and TypeScript, also within template interpolations.

    Whether a slash divides or begins a regular expression depends on what stands before. An
    interpolation is a level of its own: its braces, parentheses and expectations.
    """
    out: list[Range] = []
    levels = [_Level()]
    at = 0
    while m := _SCRIPT.search(text, at):
        level, kind, at = levels[-1], m.lastgroup, m.end()
        if kind == "open":
            break
        if kind == "line":
            out.append(m.span())
        elif kind == "block":
            end = text.find("*/", at)
            at = len(text) if end < 0 else end + 2
            out.append((m.start(), at))
        elif kind == "slash" and level.expects:
            regex = _REGEX.match(text, m.start())
            if not regex:
                break
            at = regex.end()
            level.ended()
        elif kind == "tick" or kind == "brace" and m.group() == "}" and level.braces == 1:
            if kind == "brace":
                levels.pop()
            while (t := _TEMPLATE.search(text, at)) and t.group()[0] == "\\":
                at = t.end()
            if not t:
                break
            at = t.end()
            if t.group() == "`":
                levels[-1].ended()
            else:
                levels.append(_Level(1))
        elif kind == "brace":
            level.braces += (1 if m.group() == "{" else -1) if level.braces else 0
            level.awaits()
        elif kind == "parens":
            level.parenthesis(m.group() == "(")
        elif kind in ("string", "number", "value"):
            level.ended()
        elif kind == "name":
            level.expects, level.control = m.group() in _BEFORE_VALUE, m.group() in _CONTROL
        elif kind == "double" and not level.expects:
            level.control = False
        else:
            level.awaits()
    return out


class _Level:
    """What may follow at one depth of code: a value, or an operator."""

    def __init__(self, braces: int = 0):
        self.braces, self.expects, self.control = braces, True, False
        self.stack: list[bool] = []

    def awaits(self) -> None:
        self.expects, self.control = True, False

    def ended(self) -> None:
        self.expects = self.control = False

    def parenthesis(self, opens: bool) -> None:
        if opens:
            self.stack.append(self.control)
            self.awaits()
        else:
            self.expects, self.control = bool(self.stack) and self.stack.pop(), False


def prose_ranges(text: str, kind: str) -> list[Range]:
    """The ranges of a text that are linted. An unknown kind is plain text."""
    form = KINDS.get(kind or "plain_text", "plain")
    found = {"markdown": markdown_ranges, "python": python_ranges, "rust": rust_ranges, "script": script_ranges}.get(form, lambda t: [(0, len(t))])(text)
    return without_identifiers(text, found, form in ("plain", "markdown"))

"""The YAML that front matter is written in: block and flow collections, all scalar styles, comments.

Plain scalars resolve as in the core schema of YAML 1.2, so dates stay text; what
is not text (numbers, booleans, null) comes back as such. Anchors, aliases, tags,
directives and complex keys are refused, as is what is no YAML.
"""

from __future__ import annotations

import re

INDICATORS = set("[]{},#&*!|>'\"%@`")
# The escapes of double-quoted scalars.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
HEX = {"x": 2, "u": 4, "U": 8}
NULL, BOOL = {"", "~", "null", "Null", "NULL"}, {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
PLAIN = {'"': re.compile(r'[^"\\\n]*'), "'": re.compile(r"[^'\n]*")}
NUMBER = re.compile(r"[-+]?(?:[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")


class YamlError(ValueError):
    pass


def resolved(text: str):
    """A plain scalar's value: text, None, a boolean or a number (as a double)."""
    if text in NULL:
        return None
    if text in BOOL:
        return BOOL[text]
    return 0.0 if NUMBER.fullmatch(text) else text


def folded(lines: list[str]) -> str:
    """Lines of a flow scalar as one: a line break is a space, and each empty line a line feed."""
    out, empty = lines[0], 0
    for line in lines[1:]:
        if line == "":
            empty += 1
        else:
            out, empty = out + ("\n" * empty or " ") + line, 0
    return out + ("\n" * empty if empty else "")


class _Reader:
    def __init__(self, text: str):
        self.s, self.i, self.n = text, 0, len(text)

    def fail(self, why: str):
        raise YamlError(f"{why} at character {self.i}")

    def peek(self, ahead: int = 0) -> str:
        return self.s[self.i + ahead] if self.i + ahead < self.n else ""

    def ends(self, ahead: int = 0) -> bool:
        """Whether a space, a line's end or the end comes."""
        return self.peek(ahead) in ("", " ", "\t", "\n")

    def column(self) -> int:
        return self.i - (self.s.rfind("\n", 0, self.i) + 1)

    def blanks(self) -> None:
        while self.peek() in (" ", "\t") and self.peek():
            self.i += 1

    def comment(self) -> None:
        if self.peek() == "#" and (self.i == 0 or self.s[self.i - 1] in " \t\n"):
            end = self.s.find("\n", self.i)
            self.i = self.n if end < 0 else end

    def to_content(self) -> bool:
        """Skip what means nothing; whether there is content."""
        while True:
            self.blanks()
            self.comment()
            if self.peek() != "\n":
                if self.i < self.n and "\t" in self.s[self.i - self.column() : self.i] and not self.s[self.i - self.column() : self.i].strip():
                    self.fail("tab in an indentation")
                return self.i < self.n
            self.i += 1

    def line_done(self) -> None:
        """Nothing but a comment may follow on the line."""
        before = self.i
        self.blanks()
        if self.peek() == "#" and self.i == before:
            self.fail("comment without a space")
        self.comment()
        if self.peek() not in ("", "\n"):
            self.fail("text after a value")

    def is_dash(self) -> bool:
        return self.peek() == "-" and self.ends(1)

    # block nodes; ``parent`` is the column of the collection that they lie in

    def node(self, parent: int):
        """The node that begins here, alone or as the first key of a mapping."""
        column = self.column()
        if self.is_dash():
            return self.sequence(column)
        if self.peek() == "?" and self.ends(1):
            self.fail("complex key")
        if self.peek() in ("'", '"') and self.peek():
            start = self.i
            value = self.quoted()
            self.blanks()
            if self.peek() == ":" and self.ends(1):
                self.i = start
                return self.mapping(column)
            self.line_done()
            return value
        if self.peek() not in INDICATORS and self.key_length() is not None:
            return self.mapping(column)
        return self.inline(parent)

    def key_length(self) -> int | None:
        """How long the plain key is that begins here, None if there is none on this line."""
        end = self.s.find("\n", self.i)
        line = self.s[self.i : self.n if end < 0 else end]
        found = re.match(r"(?:[^:#]|:(?=[^\s])|(?<=\S)#)*?(?=\s*:(?:\s|$))", line)
        return None if found is None else found.end()

    def mapping(self, column: int) -> dict:
        out: dict = {}
        while True:
            if self.peek() in ("'", '"') and self.peek():
                key = self.quoted()
            else:
                length = None if self.peek() in INDICATORS or self.is_dash() else self.key_length()
                if length is None:
                    self.fail("no key")
                key = self.s[self.i : self.i + length]
                self.i += length
            self.blanks()
            if self.peek() != ":" or not self.ends(1):
                self.fail("no colon")
            self.i += 1
            if key in out:
                self.fail("key twice")
            out[key] = self.after_colon(column)
            if not self.to_content() or self.column() < column:
                return out
            if self.column() > column:
                self.fail("indented too far")

    def after_colon(self, column: int):
        self.blanks()
        self.comment()
        if self.peek() not in ("", "\n"):
            if self.is_dash():
                self.fail("sequence on a key's line")
            return self.inline(column)
        if self.to_content() and (self.column() > column or self.column() == column and self.is_dash()):
            return self.node(column)
        return None

    def sequence(self, column: int) -> list:
        out = []
        while True:
            self.i += 1
            self.blanks()
            self.comment()
            if self.peek() not in ("", "\n"):
                out.append(self.node(column))
            else:
                out.append(self.node(column) if self.to_content() and self.column() > column else None)
            if not self.to_content() or self.column() < column or self.column() == column and not self.is_dash():
                return out
            if self.column() > column:
                self.fail("indented too far")

    def inline(self, column: int):
        c = self.peek()
        if c in ("|", ">"):
            return self.block_scalar(column)
        if c in ("'", '"'):
            value = self.quoted()
        elif c in ("[", "{"):
            value = self.flow()
        else:
            return self.plain(column)
        self.line_done()
        return value

    def plain(self, column: int):
        """A plain scalar, with the lines after it that are indented further than ``column``."""
        if self.peek() in INDICATORS or self.peek() in ("-", "?", ":") and self.ends(1):
            self.fail("no value")
        lines = []
        while True:
            end = self.s.find("\n", self.i)
            line = self.s[self.i : self.n if end < 0 else end]
            cut = re.search(r"\s#", line)
            text = (line[: cut.start()] if cut else line).strip()
            if re.search(r":(?:\s|$)", text):
                self.fail("mapping in a value")
            lines.append(text)
            self.i += cut.start() if cut else len(line)
            start = self.i
            if cut or end < 0:
                break
            # blank lines count only if the scalar goes on after them
            while self.peek() == "\n":
                lines.append("")
                self.i += 1
                self.blanks()
            lines.pop()
            if not self.peek() or self.column() <= column or self.peek() == "#":
                while lines and lines[-1] == "":
                    lines.pop()
                self.i = start
                break
        return resolved(folded(lines))

    def block_scalar(self, column: int) -> str:
        head = re.compile(r"([|>])(?:([1-9])([+-]?)|([+-])([1-9]?))?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|$)").match(self.s, self.i)
        if not head:
            self.fail("bad head of a block scalar")
        style, chomp, given = head[1], head[3] or head[4] or "", head[2] or head[5]
        self.i = head.end()
        indent = column + int(given) if given and column >= 0 else int(given) if given else None
        lines = []
        while self.i < self.n:
            end = self.s.find("\n", self.i)
            line = self.s[self.i : self.n if end < 0 else end]
            width = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                indent = width if indent is None else indent
                if width < indent or width <= column:
                    break
            lines.append(line[indent:] if indent is not None else "")
            self.i = self.n if end < 0 else end + 1
        self.i = max(0, self.i - 1) if self.i < self.n or self.s.endswith("\n") and self.i else self.i
        text = "\n".join(lines)
        body = text.rstrip("\n")
        rest = len(text) - len(body)
        if style == ">":
            body = re.sub(r"(?m)(?<=[^\n])\n(\n*)(?=[^\s])", lambda m: m[1] or " ", _keep_indented(body))
            body = body.replace("\0", "\n")
        return body if chomp == "-" or not body and chomp != "+" else body + "\n" * (rest + 1 if chomp == "+" else 1)

    # flow nodes

    def quoted(self) -> str:
        quote, lines, part = self.peek(), [], []
        self.i += 1
        joined = False
        while True:
            c = self.peek()
            if not c:
                self.fail("quote without an end")
            self.i += 1
            if c == "'" and quote == "'" and self.peek() == "'":
                part.append("'")
                self.i += 1
            elif c == quote:
                break
            elif c == "\\" and quote == '"':
                part.append(self.escape())
                joined = part[-1] is None
                if joined:
                    part.pop()
                    self.blanks()
            elif c == "\n":
                lines.append("".join(part).rstrip(" \t") if not joined else "".join(part))
                part, joined = [], False
                self.blanks()
            else:
                run = PLAIN[quote].match(self.s, self.i)
                part.append(c + run[0])
                self.i = run.end()
                joined = False
        lines.append("".join(part))
        if len(lines) > 1:
            lines = [lines[0], *[x.strip(" \t") if i < len(lines) - 2 else x.lstrip(" \t") for i, x in enumerate(lines[1:])]]
            text = folded(lines[:-1]) if lines[-1] == "" else folded(lines)
            text = text + " " if lines[-1] == "" and not text.endswith("\n") else text
        else:
            text = lines[0]
        # pairs of surrogates that were escaped one by one are one character
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def escape(self) -> str | None:
        """The character that an escape stands for; None for the end of a line that is joined to the next."""
        c = self.peek()
        self.i += 1
        if c == "\n":
            return None
        if c in HEX:
            digits = self.s[self.i : self.i + HEX[c]]
            if not re.fullmatch("[0-9a-fA-F]{%d}" % HEX[c], digits) or int(digits, 16) > 0x10FFFF:
                self.fail("bad escape")
            self.i += HEX[c]
            return chr(int(digits, 16))
        if c not in ESCAPES:
            self.fail("bad escape")
        return ESCAPES[c]

    def flow(self):
        if self.peek() == "[":
            return self.members("]", [], lambda out: out.append(self.entry()))
        if self.peek() == "{":
            return self.members("}", {}, self.pair)
        if self.peek() in ("'", '"'):
            return self.quoted()
        found = re.compile(r"(?:[^\n,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*").match(self.s, self.i)
        text = found[0].rstrip()
        if not text or text[0] in INDICATORS or text == "-":
            self.fail("no value")
        self.i += len(text)
        return resolved(text)

    def members(self, end: str, out, add):
        self.i += 1
        while True:
            self.to_content()
            if self.peek() == end:
                self.i += 1
                return out
            add(out)
            self.to_content()
            if self.peek() == ",":
                self.i += 1
            elif self.peek() != end:
                self.fail("no comma")

    def entry(self):
        value = self.flow()
        self.blanks()
        if self.peek() == ":" and (self.ends(1) or self.peek(1) in ",[]{}"):
            self.i += 1
            self.to_content()
            return {value: None if self.peek() in ",]" else self.flow()}
        return value

    def pair(self, out: dict) -> None:
        key = self.flow()
        if not isinstance(key, str | float | bool | None) or key in out:
            self.fail("bad key")
        self.to_content()
        out[key] = None
        if self.peek() == ":":
            self.i += 1
            self.to_content()
            if self.peek() not in (",", "}"):
                out[key] = self.flow()


def _keep_indented(text: str) -> str:
    """Line breaks next to lines that are indented further than the scalar are kept: they become NUL here."""
    lines = text.split("\n")
    out = lines[0]
    for before, line in zip(lines, lines[1:], strict=False):
        kept = line[:1] in (" ", "\t") or before[:1] in (" ", "\t")
        out += ("\0" if kept else "\n") + line
    return out


def read_yaml(text: str):
    """The value of a YAML document; YamlError if it is none."""
    reader = _Reader(text)
    if not reader.to_content():
        return None
    value = reader.node(-1)
    if reader.to_content():
        reader.fail("text after the document")
    return value

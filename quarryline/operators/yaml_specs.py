"""Specifications in YAML as JSON, in Arrow batches and without a shuffle; the operators of `ingest` then read both alike.

What specifications use is read: block and flow mappings and sequences, plain, quoted, literal and folded scalars, comments and one document. Anchors, aliases, merges, tags, directives, keys
that aren't scalars and further documents are rejected, so a small text can't become a large value. Plain words mean what they do in YAML 1.1, but dates and numbers of base 60 stay text, as .inf and .nan do.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of YAML 1.1 and what follows a backslash in double quotes.
WORDS = {"": None, "~": None, "null": None, "yes": True, "true": True, "on": True, "no": False, "false": False, "off": False}
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
MOST_DEPTH = 100

INTEGER = re.compile(r"[-+]?(0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)\Z")
FRACTION = re.compile(r"[-+]?([0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)([eE][-+][0-9]+)?\Z")
QUOTED = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'""", re.S)
ESCAPED = re.compile(r"\\(?:(\n[ \t]*)|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))|[ \t]*\n((?:[ \t]*\n)*)[ \t]*", re.S)
#: A key of a block mapping with its colon; a plain key doesn't start with a sign of another meaning.
KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S))(?:(?![ \t]#|:[ \t]|:$|[ \t]+:[ \t]|[ \t]+:$)[^\n])*)[ \t]*:(?=[ \t]|$)""", re.M)
DASH = re.compile(r"-(?:[ \t]+|$)", re.M)
HEADER = re.compile(r"[|>](?:([-+])?([1-9])?|([1-9])([-+]))[ \t]*(?:(?<=[ \t])#[^\n]*)?$", re.M)
REST = re.compile(r"[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)")
BLANK = re.compile(r"(?:\s+|(?<=\s)#[^\n]*)*")
WORD = re.compile(r"""(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s,\[\]{}:]|:(?![\s,\[\]{}])|\s+(?![\s,\[\]{}:#]))*""")
BREAK = re.compile(r"[ \t]*\n((?:[ \t]*\n)*)[ \t]*")


def plain(text: str) -> object:
    """The value of an unquoted scalar."""
    low = text.lower()
    if low in WORDS and text in (low, low.capitalize(), low.upper()):
        return WORDS[low]
    if INTEGER.match(text):
        digits = text.replace("_", "")
        sign, digits = (-1, digits[1:]) if digits[0] == "-" else (1, digits.lstrip("+"))
        octal = len(digits) > 1 and digits.isdigit() and digits[0] == "0"
        return sign * (int(digits, 8) if octal else int(digits, 0))
    return float(text.replace("_", "")) if FRACTION.match(text) else text


def folded(text: str) -> str:
    """A line break is a blank, further ones stay."""
    return BREAK.sub(lambda b: "\n" * b[1].count("\n") or " ", text)


def unquoted(m: re.Match) -> str:
    """The text of a quoted scalar, its lines folded."""

    def shown(e: re.Match) -> str:
        joined, *codes, sign, empty = e.groups()
        if joined is not None:
            return ""
        if sign is not None:
            return ESCAPES[sign]
        code = next((c for c in codes if c), None)
        return chr(int(code, 16)) if code else "\n" * empty.count("\n") or " "

    if m[1] is not None:
        return ESCAPED.sub(shown, m[1])
    return folded(m[2]).replace("''", "'")


class Yaml:
    """A document's lines and the place up to which it is read; raises ValueError or KeyError for what isn't read."""

    def __init__(self, text: str):
        self.text = re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.at, self.column, self.depth = 0, None, 0  # the line, and where in it the next node begins if not at its first sign

    def document(self) -> object:
        found = self.next()
        if found and REST.match(self.text, found[1] + 3) and self.text.startswith("---", found[1]) and not found[0]:
            self.at += 1
        out = self.block(0)
        found = self.next()
        if found and not (found[0] == 0 and re.compile(r"\.\.\.\s*\Z").match(self.text, found[1])):
            raise ValueError("text after the document")
        return out

    def next(self) -> tuple[int, int] | None:
        """Column and place of the next sign that is no comment."""
        if self.column is not None:
            return self.column, self.starts[self.at] + self.column
        while self.at < len(self.starts):
            begin = place = self.starts[self.at]
            while self.text.startswith(" ", place):
                place += 1
            sign = self.text[place : place + 1]
            if sign == "\t" and self.line(place).strip()[:1] not in ("", "#"):
                raise ValueError("a tab in an indentation")
            if sign not in ("", "\n", "#", "\t"):
                return place - begin, place
            self.at += 1
        return None

    def line(self, place: int) -> str:
        end = self.text.find("\n", place)
        return self.text[place : end if end >= 0 else len(self.text)]

    def leave(self, place: int) -> None:
        """Goes to the line after the one of a place where only a comment may follow."""
        if not REST.match(self.text, place):
            raise ValueError("text after a value")
        self.at, self.column = bisect_right(self.starts, place), None

    def block(self, least: int) -> object:
        """The node at the next line, if it is indented by `least` at least."""
        found = self.next()
        if found is None or found[0] < least:
            return None
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise ValueError("too deep")
        column, place = found
        if DASH.match(self.text, place):
            out = self.items(column)
        elif KEY.match(self.text, place):
            out = self.pairs(column)
        else:
            out = self.value(place, least - 1)
        self.depth -= 1
        return out

    def items(self, column: int) -> list:
        out = []
        while (found := self.next()) and found[0] == column and (dash := DASH.match(self.text, found[1])):
            out.append(self.after(dash.end(), column, False))
        if found and found[0] > column:
            raise ValueError("an indentation of no node")
        return out

    def pairs(self, column: int) -> dict:
        out: dict = {}
        while (found := self.next()) and found[0] == column:
            key = KEY.match(self.text, found[1])
            if not key:
                if DASH.match(self.text, found[1]) or self.text.startswith(("...", "---"), found[1]):
                    break
                raise ValueError("no key")
            quoted = QUOTED.fullmatch(key[1])
            if key[1] == "<<":
                raise ValueError("a merge")
            name = unquoted(quoted) if quoted else self.name(plain(key[1].rstrip()))
            blanks = re.compile(r"[ \t]*").match(self.text, key.end()).end()
            out[name] = self.after(blanks, column, True)
        if found and found[0] > column:
            raise ValueError("an indentation of no node")
        return out

    @staticmethod
    def name(key: object) -> str:
        return key if isinstance(key, str) else json.dumps(key)

    def after(self, place: int, column: int, mapping: bool) -> object:
        """What follows a dash or a key's colon at a column: on its line or, if nothing is there, on the next ones."""
        if REST.match(self.text, place):
            self.leave(place)
            found = self.next()
            return self.block(column if mapping and found and DASH.match(self.text, found[1]) else column + 1)
        if not mapping and (DASH.match(self.text, place) or KEY.match(self.text, place)):
            self.column = place - self.starts[self.at]
            return self.block(column + 1)
        return self.value(place, column)

    def value(self, place: int, column: int) -> object:
        """A scalar or a flow node; further lines of it are indented by more than `column`."""
        sign, self.column = self.text[place], None
        if sign in "|>":
            return self.lines(place, column)
        if sign in "\"'":
            quoted = QUOTED.match(self.text, place)
            if not quoted:
                raise ValueError("an open quote")
            self.leave(quoted.end())
            return unquoted(quoted)
        if sign in "[{":
            out, end = self.flow(place)
            self.leave(end)
            return out
        return self.words(place, column)

    def words(self, place: int, column: int) -> object:
        """A plain scalar, also of several lines: a line break is a blank, empty lines stay. A comment ends it."""
        if self.text[place] in "&*!%@`#,]}" or re.compile(r"[-?:](?:\s|\Z)").match(self.text, place):
            raise ValueError("a sign that isn't read")
        parts, empty = [], 0
        while True:
            whole = self.line(place)
            bare = re.split(r"[ \t]#", whole, maxsplit=1)[0].strip()
            if re.search(r":(?:[ \t]|\Z)", bare):
                raise ValueError("a key within a scalar")
            parts.append(("\n" * empty or " ") * bool(parts) + bare)
            self.at, empty, commented = self.at + 1, 0, bare != whole.strip()
            while self.at < len(self.starts) and not self.line(self.starts[self.at]).strip():
                self.at, empty = self.at + 1, empty + 1
            if self.at == len(self.starts):
                break
            line = self.line(self.starts[self.at])
            bare = line.lstrip(" ")
            if len(line) - len(bare) <= column or bare.startswith("#") or (line == bare and bare.startswith(("---", "..."))):
                break
            if commented:
                raise ValueError("a scalar goes on after a comment")
            place = self.starts[self.at] + len(line) - len(bare)
        return plain(parts[0]) if len(parts) == 1 else "".join(parts)

    def lines(self, place: int, column: int) -> str:
        """A literal or folded scalar."""
        header = HEADER.match(self.text, place)
        if not header:
            raise ValueError("no header of a scalar")
        chomp, given = header[1] or header[4], header[2] or header[3]
        depth = max(column, 0) + int(given) if given else None
        self.at, own = self.at + 1, []
        while self.at < len(self.starts):
            line = self.line(self.starts[self.at])
            indent = len(line) - len(line.lstrip(" "))
            if indent < len(line):
                if depth is None:
                    depth = max(indent, column + 1)
                if indent < depth:
                    break
            own.append(line[depth:] if depth is not None else "")
            self.at += 1
        if self.at == len(self.starts) and own and own[-1] == "":
            own.pop()  # what follows the last line feed is no line
        text = "\n".join(own)
        body = text.rstrip("\n")
        ends = len(own) - body.count("\n") - 1 if body else len(own)
        if self.text[place] == ">":
            body = re.sub(r"(?m)(^[^ \t\n].*)\n(\n*)(?=[^ \t\n])", lambda m: m[1] + (m[2] or " "), body)
        last = self.at < len(self.starts) or self.text.endswith("\n") or ends > 0
        if chomp == "+":
            return body + "\n" * (ends + bool(body and last))
        return body + "\n" * bool(body and last and chomp != "-")

    def flow(self, place: int) -> tuple[object, int]:
        """A flow node and the place after it."""
        sign = self.text[place : place + 1]
        if sign in ('"', "'"):
            quoted = QUOTED.match(self.text, place)
            if not quoted:
                raise ValueError("an open quote")
            return unquoted(quoted), quoted.end()
        if sign not in ("[", "{"):
            word = WORD.match(self.text, place)
            if not word:
                raise ValueError("a sign that isn't read")
            return plain(folded(word[0])), word.end()
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise ValueError("too deep")
        close, out, skip = ("]", [], place + 1) if sign == "[" else ("}", {}, place + 1)
        place = BLANK.match(self.text, skip).end()
        while not self.text.startswith(close, place):
            quoted = self.text[place : place + 1] in ('"', "'")
            one, place = self.flow(place)
            place = BLANK.match(self.text, place).end()
            if sign == "[":
                out.append(one)
            else:
                if isinstance(one, (list, dict)) or (one == "<<" and not quoted):
                    raise ValueError("a merge, or a key that is no scalar")
                value = None
                if self.text.startswith(":", place) and (quoted or re.compile(r"[\s,\[\]{}]").match(self.text, place + 1)):
                    place = BLANK.match(self.text, place + 1).end()
                    if self.text[place : place + 1] not in (",", "}"):
                        value, place = self.flow(place)
                        place = BLANK.match(self.text, place).end()
                out[self.name(one)] = value
            if self.text.startswith(",", place):
                place = BLANK.match(self.text, place + 1).end()
            elif not self.text.startswith(close, place):
                raise ValueError("no end of a flow node")
        self.depth -= 1
        return out, place + 1


#: Lines and block scalars up to this length are read once and remembered; specifications repeat most of theirs.
SHORT, REMEMBERED = 200, 50_000
#: Containers within each other and brackets of a line that `quick` reads: fewer together than MOST_DEPTH.
QUICK_DEPTH = 40
NAME = re.compile(r"([A-Za-z_/][A-Za-z0-9_/.{}\-]*):(?: ([A-Za-z][A-Za-z0-9_]*))?\Z")
UNREAD = re.compile(r"[ \t]*[&*!%@`,\]}]")


class Unusual(Exception):
    """A text that `quick` leaves to `Yaml`."""


def line_pair(line: str) -> tuple[str, object, str]:
    """(key, value, kind) of a line without indentation that is a pair of a block mapping: "value", "open" if the value is on the next lines, "block" with a block scalar's header, or "unread"."""
    simple = NAME.match(line)
    if simple and simple[1].lower() not in WORDS:
        return simple[1], plain(simple[2]) if simple[2] else None, "value" if simple[2] else "open"
    key = KEY.match(line)
    if not key or line.startswith(("---", "...")) or line.count("[") + line.count("{") > QUICK_DEPTH:
        raise Unusual
    place = re.compile(r"[ \t]*").match(line, key.end()).end()
    if UNREAD.match(line, place):
        return "", None, "unread"
    try:
        ((name, value),) = Yaml(line).document().items()
    except (ValueError, KeyError, OverflowError) as error:
        raise Unusual from error
    if REST.match(line, place):
        return name, None, "open"
    if line[place] not in "|>":
        return name, value, "value"
    if re.search(r"\d", line[place:]):
        raise Unusual
    return name, line[place:], "block"


def block_scalar(header: str, body: str) -> str:
    return Yaml(f"k: {header}\n{body}").document()["k"]


known_pair, known_scalar = lru_cache(REMEMBERED)(line_pair), lru_cache(REMEMBERED // 10)(block_scalar)


def quick(text: str) -> object:
    """What `Yaml` makes of a text of block mappings and sequences whose other nodes are each on one line or a block scalar, line by line; raises Unusual for all else, and where `Yaml` has to tell what is wrong."""
    if "\t" in text or "\r" in text or text.startswith("\ufeff"):
        raise Unusual
    lines = text.split("\n")
    first = next((k for k, line in enumerate(lines) if line.strip(" ") and line.lstrip(" ")[0] != "#"), len(lines))
    at = first + 1 if first < len(lines) and lines[first].rstrip(" ") == "---" else first
    root: list = [None]
    stack: list[tuple[int, dict | list]] = []
    place, slot, least = root, 0, -1  # where the value of an open key or dash comes, and the column of that
    pending, mapping = True, False
    end = len(lines)
    while at < end:
        whole = lines[at]
        line = whole.lstrip(" ")
        at += 1
        if not line or line[0] == "#":
            continue
        column = len(whole) - len(line)
        while True:  # once for each dash of the line, then for what follows
            dash = line[0] == "-" and (len(line) == 1 or line[1] == " ")
            if pending and (column > least or (mapping and dash and column == least)):
                if len(stack) == QUICK_DEPTH:
                    raise Unusual
                own = [] if dash else {}
                place[slot] = own
                stack.append((column, own))
            else:
                while stack and stack[-1][0] > column:
                    stack.pop()
                if stack and isinstance(stack[-1][1], list) and not dash and stack[-1][0] == column:
                    stack.pop()
                if not stack or stack[-1][0] != column or isinstance(stack[-1][1], list) != dash:
                    raise Unusual
                own = stack[-1][1]
            if not dash:
                break
            own.append(None)
            place, slot, least, pending, mapping = own, len(own) - 1, column, True, False
            rest = line[1:].lstrip(" ")
            if not rest or rest[0] == "#":
                line = ""
                break
            if not (rest[0] == "-" and (len(rest) == 1 or rest[1] == " ")) and not KEY.match(rest):
                own[-1], pending, line = item(rest), False, ""
                break
            column, line = column + len(line) - len(rest), rest
        if not line:
            continue
        key, value, kind = known_pair(line) if len(line) <= SHORT else line_pair(line)
        if kind == "unread":
            raise ValueError("a sign that isn't read")
        pending, mapping = kind == "open", True
        if kind == "block":
            begin, depth = at, None
            while at < end:
                bare = lines[at].lstrip(" ")
                if bare:
                    indent = len(lines[at]) - len(bare)
                    if depth is None:
                        if indent <= column:
                            raise Unusual
                        depth = indent
                    if indent < depth:
                        break
                at += 1
            if depth is None:
                raise Unusual
            body = "\n".join(lines[begin:at]) + ("\n" if at < end else "")
            value = known_scalar(value, body) if len(body) <= SHORT else block_scalar(value, body)
        own[key] = value
        place, slot, least = own, key, column
    if root[0] is None:
        raise Unusual
    return root[0]


def item(text: str) -> object:
    """The value of a dash's line: a plain scalar, or what `Yaml` reads from it alone."""
    if text[0] in "|>" or text.count("[") + text.count("{") > QUICK_DEPTH or text.startswith(("---", "...")):
        raise Unusual
    try:
        return Yaml(text).document()
    except (ValueError, KeyError, OverflowError) as error:
        raise Unusual from error


def document(text: str) -> object:
    try:
        return quick(text)
    except Unusual:
        return Yaml(text).document()


def json_of(text: str | None) -> str | None:
    """JSON of a YAML mapping; null for what isn't one or isn't read."""
    if text is None:
        return None
    try:
        out = document(text)
        return json.dumps(out, ensure_ascii=False) if isinstance(out, dict) else None
    except (ValueError, KeyError, OverflowError):
        return None


def specs_as_json(specs: DataFrame) -> DataFrame:
    """specs with JSON in `spec`: JSON as it is, YAML mappings as JSON, null for the rest (null, empty and broken texts too). Other columns and repeated rows stay.

    Only texts that aren't JSON go to Python; a text is one value of one row, whatever its length. Where several operators read the specs, write the result first.
    """

    @F.pandas_udf("string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: json_of(t) if isinstance(t, str) else None).astype(object)

    is_json = F.coalesce(F.try_parse_json("spec").isNotNull(), F.lit(False))
    return specs.withColumn("spec", F.when(is_json, F.col("spec")).otherwise(read(F.when(~is_json, F.col("spec")))))

"""Reading the metadata header of a note: a controlled flat grammar, strict (v2) or lenient (v1).

These are per-note helpers for Arrow tasks over the header column; rules about the values are column expressions.
A value is (type, scalar, items): type is ``empty``, ``null``, ``scalar`` or ``list``; a null list item is a null one.
"""

from __future__ import annotations

import re

Value = tuple[str, str | None, list[str | None] | None]
SYNTAX, DUPLICATE = "SYNTAX", "DUPLICATE"
_FIELD = re.compile(r"([A-Za-z][A-Za-z0-9_-]*):(.*)\Z", re.S)
_REST = re.compile(r"[ \t]*(?:[ \t]#.*)?\Z", re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*)'")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ESCAPE = re.compile(r"\\(u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", re.S)
_PLAIN = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}
#: Characters that may not begin a bare value.
RESERVED = "-?:,[]{}#&*!|>'\"%@`"


class HeaderError(ValueError):
    def __init__(self, code: str, field: str | None = None):
        super().__init__(code)
        self.code, self.field = code, field


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if code in _PLAIN:
            return _PLAIN[code]
        if len(code) == 11:
            return chr(0x10000 + ((int(code[1:5], 16) - 0xD800) << 10) + int(code[7:], 16) - 0xDC00)
        if code[0] == "u" and len(code) == 5 and not 0xD800 <= int(code[1:], 16) < 0xE000:
            return chr(int(code[1:], 16))
        raise HeaderError(SYNTAX)

    return _ESCAPE.sub(one, text)


def _bare(text: str) -> str | None:
    text = text.strip(" \t")
    if text == "~" or text.lower() == "null":
        return None
    spaced = re.search(r":(?:[ \t]|\Z)|[ \t][&*!]", text)
    if not text or text == "..." or text[0] in RESERVED or spaced:
        raise HeaderError(SYNTAX)
    return text


def _before_comment(text: str) -> str:
    found = re.search(r"(?:\A|[ \t])#", text)
    return text[: found.start()] if found else text


def _scalar(text: str) -> str | None:
    """A whole value: quoted with nothing but a comment behind it, or bare."""
    text = text.lstrip(" \t")
    for pattern, decode in ((_SINGLE, lambda s: s.replace("''", "'")), (_DOUBLE, _unescape)):
        if text[:1] == pattern.pattern[0]:
            m = pattern.match(text)
            if not m or not _REST.match(text, m.end()):
                raise HeaderError(SYNTAX)
            return decode(m[1])
    return _bare(_before_comment(text))


def _flow_list(lines: list[str], at: int, text: str) -> tuple[list[str | None], int]:
    """Items of a list that opens in ``text`` on line ``at - 1``, and the line after it."""
    items: list[str | None] = []
    text, wants_item, fresh = text[1:], True, True

    def gap() -> None:
        """Skips space, comments and line ends."""
        nonlocal text, at, fresh
        while True:
            bare = text.lstrip(" \t")
            if bare and not (bare[0] == "#" and (fresh or bare != text)):
                text = bare
                return
            if at >= len(lines):
                raise HeaderError(SYNTAX)
            text, at, fresh = lines[at], at + 1, True

    while True:
        gap()
        fresh = False
        if text[0] == "]":
            if (wants_item and items) or not _REST.match(text, 1):
                raise HeaderError(SYNTAX)
            return items, at
        if text[0] == ",":
            if wants_item:
                raise HeaderError(SYNTAX)
            text, wants_item = text[1:], True
            continue
        if not wants_item:
            raise HeaderError(SYNTAX)
        m = {"'": _SINGLE, '"': _DOUBLE}.get(text[0], re.compile(r"(?:[^,\]\s]|[ \t]+(?![ \t#,\]]|\Z))+")).match(text)
        if not m:
            raise HeaderError(SYNTAX)
        items.append(m[1].replace("''", "'") if text[0] == "'" else _unescape(m[1]) if text[0] == '"' else _bare(m[0]))
        text, wants_item = text[m.end() :], False


def _block(lines: list[str], at: int, folded: bool) -> tuple[str, int]:
    content: list[str] = []
    while at < len(lines) and (not lines[at].strip(" \t") or lines[at].startswith("  ")):
        content.append(lines[at][2:] if lines[at].strip(" \t") else "")
        at += 1
    while content and not content[-1]:
        content.pop()
    if not folded:
        return "\n".join(content), at
    out = ""
    for m in re.finditer(r"(\n*)([^\n]+)", "\n".join(content)):
        breaks = len(m[1])
        out += ("\n" if not out and breaks else " " if breaks == 1 else "\n" if breaks else "") + m[2]
    return out, at


def parse_strict(header: str) -> list[tuple[str, Value]]:
    """Fields in order; raises HeaderError on anything the grammar doesn't hold."""
    if "\ufeff" in header or re.search(r"\r(?!\n)", header) or len(header.encode()) > 1 << 20:
        raise HeaderError(SYNTAX)
    lines, at, fields = header.replace("\r\n", "\n").split("\n"), 0, []
    seen: set[str] = set()
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip(" \t") or line.lstrip(" \t").startswith("#"):
            continue
        m = _FIELD.match(line)
        if not m:
            raise HeaderError(SYNTAX)
        key, text = m[1], m[2].strip(" \t")
        if key in seen:
            raise HeaderError(DUPLICATE, key)
        seen.add(key)
        if not text or text[0] == "#":
            items = []
            while at < len(lines) and lines[at].startswith("  - "):
                items.append(_scalar(lines[at][4:]))
                at += 1
            fields.append((key, ("list", None, items) if items else ("empty", None, None)))
        elif text[0] == "[":
            items, at = _flow_list(lines, at, text)
            fields.append((key, ("list", None, items)))
        elif re.match(r"[|>][ \t]*(?:[ \t]#.*)?\Z", text):
            block, at = _block(lines, at, text[0] == ">")
            fields.append((key, ("scalar", block, None)))
        else:
            value = _scalar(text)
            fields.append((key, ("null", None, None) if value is None else ("scalar", value, None)))
    return fields


#: The lenient grammar as one expression: a field with all the lines of its value, or one line of no field.
LOOSE = re.compile(
    r"""
    ^(?P<key>[A-Za-z_][\w-]*)\s*?:[ \t]*
    (?:
        (?P<block>[|>][^\n]*(?:\n|\Z)(?:[ \t]+[^\n]*(?:\n|\Z)|[ \t\r]*\n)*)
      | (?P<flow>\[(?:{code}(?:\#[^\n]*)?\n)*?{code}\][ \t]*(?:\#[^\n]*)?\r?(?:\n|\Z) | \[(?!{code}\][ \t]*(?:\#[^\n]*)?\r?$)(?s:.*))
      | (?P<items>(?:\#[^\n]*)?\r?\n(?:[ \t]+-[ ][^\n]*(?:\n|\Z))+)
      | (?P<plain>[^\n]*(?:\n|\Z))
    )
    | ^[^\n]*(?:\n|\Z)
    """.replace("{code}", r"""(?:"[^"\n]*"|[^\s\#"]\#|[^\n\#"])*?"""),
    re.M | re.X,
)
_COMMENT = re.compile(r"""((?:"[^"]*"|'[^']*'|\S\#|[^\#])*?)(?:(?:(?<=\s)|\A)\#.*)?\Z""")
_ITEM = re.compile(r"""\s*((?:"[^"]*"|'[^']*'|[^,"']|["'])+?)\s*(?:,|\Z)""")
#: What stands for no value.
NOTHING = ("", "~", "null", "Null", "NULL")


def loose_spans(header: str) -> list[re.Match]:
    """The header cut into fields and lines of no field; their texts joined are the header."""
    return [m for m in LOOSE.finditer(header) if m[0]]


def _loose_scalar(text: str) -> str | None:
    """A value without its comment and quotes; None where it stands for none."""
    text = _COMMENT.match(text.strip())[1].strip()
    if text in NOTHING:
        return None
    quote = re.fullmatch(r"""(["'])(.*)\1""", text, re.S)
    return text if not quote else re.sub(r'\\(["\\])', r"\1", quote[2]) if quote[1] == '"' else quote[2]


def loose_value(field: re.Match) -> Value:
    if field["block"]:
        folded = " ".join(field["block"].split("\n", 1)[1].split())
        return ("scalar", folded, None) if folded else ("null", None, None)
    if field["items"]:
        return "list", None, [_loose_scalar(line.strip()[2:]) for line in field["items"].splitlines()[1:]]
    if field["flow"]:
        text = " ".join(_COMMENT.match(line.strip())[1].strip() for line in field["flow"].splitlines()).strip()
        if text.endswith("]"):
            return "list", None, [_loose_scalar(x) or "" for x in _ITEM.findall(text[1:-1].strip())]
    value = _loose_scalar(field["plain"] or field["flow"])
    return ("null", None, None) if value is None else ("scalar", value, None)


def parse_loose(header: str) -> list[tuple[str, Value]]:
    """Lines that can't be read are skipped, a later key replaces an earlier one."""
    return list({m["key"]: loose_value(m) for m in loose_spans(header) if m["key"]}.items())

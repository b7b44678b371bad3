"""Masking of values that look like credentials; line breaks stay, and masking twice changes nothing.

Texts that hold no sign of a secret never leave Spark. The others go through
one Arrow pass that walks each text: key blocks, tokens, bearer values, and
values that are assigned to a name of secrets.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The replacement, the token families and the names that announce a secret.
HIDDEN = "[secret hidden]"
TOKENS = (
    r"sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{30,}",
    r"AKIA[0-9A-Z]{16}\b",
    r"xox[abposr]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}\b",
)
NAMES = r"api[_-]?key|secret|token|passw(?:or)?d"
#: Characters of a key block, lines of one that is cut off, characters after a name, and of the shortest value.
KEY_CHARS, KEY_LINES, NAME_TAIL, SHORTEST = 16_384, 100, 40, 8

_SIGNS = rf"(?i)sk-|gh[pousr]_|github_pat_|akia|xox[abposr]-|aiza|bearer|-----begin |{NAMES}"
#: A token starts where no word is under way; the letter of an escape does not count as one.
_START = r"(?:(?<!\w)|(?<=\\[nrt]))"
_TOKEN = re.compile("|".join(_START + t for t in TOKENS))
_BEARER = re.compile(rf"({_START}(?i:bearer)[ \t]+)[A-Za-z0-9._~+/-]{{20,}}=*")
_KEY_HEAD, _KEY_FOOT = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_ESCAPE = re.compile(r"\\[nrt]")
_BREAK, _BREAK_AHEAD = re.compile(r"\r?\n|(?:\\r)?\\n"), re.compile(r"\r?\n|\\[rn]|[\"'`]|\Z")
_KEY_TEXT, _KEY_FIELD = re.compile(r"[A-Za-z0-9+/=]{1,257}"), re.compile(r"[A-Za-z-]{1,64}: [^\n\"'`\\]{0,256}")
_LINE = re.compile("[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+")

_NAME = re.compile(rf"(?i:{NAMES})")
_NAME_SIGNS, _BLANKS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"), frozenset(" \t")
_QUOTED, _BARE = re.compile(r"[^\s\"'`\\]*"), re.compile(r"[^\s\"'`,;&\\()\[\]{}<>]*")
_NUMBER, _DOTTED = re.compile(r"[0-9.]+\b"), re.compile(r"[a-z_]+(?:\.[a-z_][a-z0-9_]*)+")
_ENDS = frozenset(" \t\n\r\x0b\x0c\"'`,;&\\)]}>")


def _skip(text: str, at: int, signs: frozenset[str]) -> int:
    while at < len(text) and text[at] in signs:
        at += 1
    return at


def _ended(text: str, at: int) -> bool:
    return at >= len(text) or text[at] in _ENDS or text[at].isspace()


def _quote_at(text: str, at: int) -> str:
    """The quote that stands there, with the backslash of an escaped one."""
    slash = text[at : at + 1] == "\\"
    return text[at : at + 1 + slash] if text[at + slash : at + 1 + slash] in ("'", '"') else ""


def _value_start(text: str, at: int) -> int | None:
    """Where the value of a name that ends before ``at`` may begin: after the name's rest, a colon or equals sign, and a line break at most."""
    tail = _skip(text, at, _NAME_SIGNS)
    if tail - at > NAME_TAIL:
        return None
    tail = _skip(text, tail + len(_quote_at(text, tail)), _BLANKS)
    if text[tail : tail + 1] not in (":", "="):
        return None
    tail = _skip(text, tail + 1, _BLANKS)
    for end in ("\r\n", "\n"):
        if text.startswith(end, tail):
            return _skip(text, tail + len(end), _BLANKS)
    return tail


def _is_secret(text: str, start: int, end: int) -> bool:
    """Whether a value is long enough, and neither a number nor a dotted name of code."""
    dotted = _DOTTED.match(text, start)
    return end - start >= SHORTEST and not _NUMBER.match(text, start) and not (dotted and _ended(text, dotted.end()))


def _secret_value(text: str, at: int) -> tuple[int, int] | None:
    """The value there that must be hidden: inside its quote, or up to the end of the word."""
    quote = _quote_at(text, at)
    start = at + len(quote)
    if quote:
        end = _QUOTED.match(text, start).end()
        if _is_secret(text, start, end) and (text.startswith(quote, end) or _ended(text, end)):
            return start, end
        return None
    end = _BARE.match(text, start).end()
    return (start, end) if _is_secret(text, start, end) and _ended(text, end) else None


def _hide_assigned(text: str) -> str:
    out, at, searched = [], 0, 0
    while name := _NAME.search(text, searched):
        searched = name.start() + 1
        start = _value_start(text, name.end())
        found = _secret_value(text, start) if start is not None else None
        if found:
            out += [text[at : found[0]], HIDDEN]
            at = searched = found[1]
    return "".join([*out, text[at:]])


def _key_end(text: str, at: int) -> int:
    """Where a key block ends whose head ends at ``at``: with its foot, or, cut off, after its last line of key text."""
    foot = _KEY_FOOT.search(text, at, at + KEY_CHARS + 80)
    if foot and foot.start() - at <= KEY_CHARS:
        body = text[at : foot.start()]
        if "-----BEGIN " not in body and not set("\"'`\\") & set(_ESCAPE.sub("", body)):
            return foot.end()
    for _ in range(KEY_LINES):
        line = _BREAK.match(text, at)
        if not line:
            break
        own = _KEY_TEXT.match(text, line.end())
        if own and own.end() - own.start() <= 256 and _BREAK_AHEAD.match(text, own.end()):
            at = own.end()
        elif field := _KEY_FIELD.match(text, line.end()):
            at = field.end()
        else:
            break
    return at


def _hide_keys(text: str) -> str:
    out, at = [], 0
    while head := _KEY_HEAD.search(text, at):
        end = _key_end(text, head.end())
        out += [text[at : head.start()], _LINE.sub(lambda line: HIDDEN if line.group().strip() else line.group(), text[head.start() : end])]
        at = end
    return "".join([*out, text[at:]])


def hide(text: str) -> str:
    """``text`` with its secrets replaced: key blocks line for line, tokens, bearer values, then assigned values."""
    return _hide_assigned(_BEARER.sub(r"\1" + HIDDEN, _TOKEN.sub(HIDDEN, _hide_keys(text))))


@F.arrow_udf(T.StringType())
def _hidden(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hide(t) for t in texts.to_pylist()], pa.string())


def mask_secrets(text: Column) -> Column:
    """``text`` with secrets replaced by HIDDEN; null stays null. Only texts with a sign of a secret are walked."""
    return F.coalesce(_hidden(F.when(text.rlike(_SIGNS), text)), text)

"""Secret scans: patterns for known shapes, and an assignment-aware lexer that scores literals by the name they go to."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: As runs of [0-9a-f]+ of 24 or more: a match begins where a run does, or the run is too short.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: How strongly a part of a target's name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0,
    "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "authkey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.8, "pass": 0.7, "key": 0.4,
}
#: Literals that stand for a secret and are none.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "your", "dummy", "xxxxxxxx", "redacted"}
NEEDED = 0.55
#: Any part of a sensitive name begins with one of these.
_SENSITIVE = re.compile("pass|pwd|secret|token|key|credential|auth|bearer", re.I | re.A)

#: The lexer's tokens: quoted literals (also of several lines), names with dots and hyphens, operators, brackets, signs of comments, line ends.
_TOKEN = re.compile(
    r"""(?P<long>(?<!\w)[rbfuRBFU]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}))"""
    r"""|(?P<text>(?<!\w)[rbfuRBFU]{0,2}(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`))"""
    r"""|(?P<name>[A-Za-z_$][\w$]*+(?:[.\-][\w$]++)*+)|(?P<assign>:=|=>|=(?![=~])|(?<!:):(?![:/]))|(?P<other>==|::|->|\#|//|/\*|[-+.,;(){}\[\]<>|&\n])""",
    re.A | re.S,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""", re.A)
_BLOCK = re.compile(r"[>|][-+0-9]*[\x20\t]*\n")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]{0,99})>(?P<value>[^<>\s]+)</", re.A)
_OPENS, _CLOSES = "([{", ")]}"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in code points, leftmost and not overlapping within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def name_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1: the strongest of its parts and of its adjoining parts together."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    return max((SENSITIVE.get(x, 0.0) for n in (1, 2) for x in ("".join(parts[i : i + n]) for i in range(len(parts) - n + 1))), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, kinds of characters and entropy; words of prose have little."""
    if len(value) < 6 or re.search(r"[\s$%{}<>]", value) or value.lower().strip("'\"") in PLACEHOLDERS or len(set(value)) < 4:
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in map(value.count, set(value)))
    digits = 1.0 if re.search("[0-9]", value) else 0.5
    return min(1.0, digits * (0.25 * min(kinds, 3) / 3 + 0.35 * min(len(value), 20) / 20 + 0.4 * min(entropy, 4.0) / 4.0))


class _Scope:
    """What the lexer knows within a pair of brackets, or outside all: the target of the value being read, its literals, and the arguments so far."""

    __slots__ = ("target", "spans", "typed", "first", "place", "opened", "key")

    def __init__(self, target: str | None, opened: str) -> None:
        self.target, self.opened = target, opened
        self.spans: list[tuple[int, int]] = []
        self.typed: str | None = None
        self.first: str | None = None
        self.key: str | None = None
        self.place = 0


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(name, spans of its literals) of source and configuration text, in order, constants being propagated.

    A lexer goes over quoted literals, names, operators, brackets, comments and line ends. A target is the name, quoted key or
    subscript before an operator; a declared type between them is passed over. Its value runs to the end of the line or to
    the next comma or semicolon of the same brackets, or is a literal of several lines or an indented block; literals within
    the brackets of a call or list belong to the target too, unless they have one of their own. Of a call with a quoted first
    argument, that names the literals of the second; in a tag, an attribute `value` has the name that `key` or `name` gives.
    A name in a value stands for the literals last assigned to it.
    """
    known: dict[str, list[tuple[int, int]]] = {}
    scopes = [_Scope(None, "")]
    last: str | None = None
    at, n = 0, len(text)

    def put(spans: list[tuple[int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Literals of the value being read; those of a second argument have the first as their name."""
        scope = scopes[-1]
        scope.spans += spans
        if scope.opened == "(" and scope.target is None and scope.place == 1 and scope.first:
            yield scope.first, list(spans)

    def ended() -> Iterator[tuple[str, list[tuple[int, int]]]]:
        scope = scopes[-1]
        if scope.target is not None and scope.spans:
            name = scope.target
            if name.lower() == "value" and scope.key:
                name = scope.key
            elif name.lower() in ("key", "name"):
                scope.key = text[slice(*scope.spans[0])]
            known[scope.target] = scope.spans
            yield name, scope.spans
        scope.target, scope.spans, scope.typed = None, [], None

    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            at += 1
            if text[at - 1] not in " \t\r":
                last = None if last != "]" else last
            continue
        at, kind, said, scope = m.end(), m.lastgroup, m[0], scopes[-1]
        if kind in ("long", "text"):
            quote = said.lstrip("rbfuRBFU")[0]
            size = 3 if kind == "long" else 1
            begin = m.start() + said.index(quote) + size
            if kind == "long":
                inside = text[begin : m.end() - size]
                begin, end = begin + len(inside) - len(inside.lstrip()), m.end() - size - (len(inside) - len(inside.rstrip()))
                spans = [(begin, max(begin, end))]
            else:
                spans = [(begin, m.end() - size)]
            if scope.opened in ("(", "[") and scope.target is None and scope.place == 0 and scope.first is None:
                scope.first = text[slice(*spans[0])]
            yield from put([x for x in spans if x[1] > x[0]])
            last = text[slice(*spans[0])]
        elif kind == "name":
            if scope.target is not None and not scope.spans:
                scope.typed = said
            if said in known and scope.target != said:
                yield from put([x for x in known[said] if x not in scope.spans])
            last = said
        elif kind == "assign":
            if said == "=" and scope.typed is not None and scope.target is not None and not scope.spans:
                # a type is passed over, but a word before a colon in prose is no target
                if name_score(scope.typed) > name_score(scope.target):
                    scope.target = scope.typed
                scope.typed = None
            elif last:
                # a quoted key was read as a literal of what is before it
                scope.spans = [x for x in scope.spans if text[slice(*x)] != last]
                yield from ended()
                scope.target = last
            else:
                continue
            last = None
            while at < n and text[at] in " \t":
                at += 1
            if block := _BLOCK.match(text, at):
                line = text.rfind("\n", 0, m.start()) + 1
                indent = len(text[line:]) - len(text[line:].lstrip(" ")) if line == m.start() else m.start() - line - len(text[line : m.start()].lstrip(" "))
                at = block.end()
                while at < n:
                    stop = text.find("\n", at)
                    stop = n if stop < 0 else stop
                    own = text[at:stop]
                    if own.strip() and len(own) - len(own.lstrip(" ")) <= indent:
                        break
                    if own.strip():
                        scope.spans.append((at + len(own) - len(own.lstrip()), at + len(own.rstrip())))
                    at = stop + 1
                at = min(at, n)
                yield from ended()
            elif bare := _BARE.match(text, at):
                value = bare[0]
                follows = text[bare.end() : bare.end() + 1]
                if value in known or follows in ("(", "[", '"', "'", "`") or value.startswith(("+", "=", "#", "//")) or re.match(r"\s*=(?!=)|\x20*\+", text[bare.end() : bare.end() + 40]):
                    continue
                end = at + len(value.rstrip(".,;:!?"))
                if end > at:
                    yield from put([(at, end)])
                at = bare.end()
        elif said in _OPENS:
            scopes.append(_Scope(scope.target if said != "{" else None, said))
            scopes[-1].target = None
            last = None
        elif said in _CLOSES:
            spans = scope.spans if scope.target is None else []
            yield from ended()
            scope.spans = spans
            if len(scopes) > 1:
                inner = scopes.pop()
                if inner.opened == "[" and scopes[-1].target is None:
                    last = inner.first or last
                elif scopes[-1].target is not None:
                    scopes[-1].spans += inner.spans
                    last = None
            else:
                last = None
        elif said == ",":
            spans = scope.spans if scope.target is None else []
            yield from ended()
            scope.spans, scope.place, last = spans, scope.place + 1, None
        elif said in (";", "#", "//", "/*") or said == "\n":
            if said == "\n" and scope.opened and scope.target is None:
                continue
            yield from ended()
            last = None
            if not scope.opened:
                scope.key = None
        elif said in "<>":
            yield from ended()
            scope.key = last = None
    while scopes:
        yield from ended()
        scopes.pop()


def literal_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants.

    A literal's score is its own, or that of all literals of the value together, times its target's; it is a secret from
    NEEDED on. Quotes are not part of the span. Text without any part of a sensitive name has none and is not read further.
    """
    if not _SENSITIVE.search(text):
        return []
    found: dict[tuple[int, int], float] = {}
    tags = ((m["name"], [m.span("value")]) for m in _TAG.finditer(text)) if "</" in text else ()
    for name, spans in chain(assignments(text), tags):
        if weight := name_score(name):
            spans = list(dict.fromkeys(spans))
            joined = literal_score("".join(text[a:b] for a, b in spans))
            for a, b in spans:
                found[a, b] = max(found.get((a, b), 0.0), weight * max(joined if b - a >= 4 else 0.0, literal_score(text[a:b])))
    return sorted((a, "literal", b) for (a, b), score in found.items() if score >= NEEDED)


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans: the base ones and the lexer's, less the lexer's that lie within a base span."""
    base = base_spans(text or "")
    # base spans are in order of their starts: those that may hold a literal end within a running maximum
    starts, furthest = [], []
    for a, _, b in base:
        starts.append(a)
        furthest.append(max(b, furthest[-1] if furthest else 0))
    within = lambda a, b: (i := bisect_right(starts, a)) > 0 and furthest[i - 1] >= b
    more = [x for x in literal_spans(text or "") if not within(x[0], x[2])]
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[1])))


def secrets_column(text: Column) -> Column:
    """struct<n_assign, n_access, n_hex, base_sha256, spans>; null and empty texts have no spans."""
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                base, spans = scan(t)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned(text)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and the columns of secrets_column. An empty table gives an empty result; repeated rows repeat.

    Null and empty texts have no spans, and the digest of an empty list. Of spans that start together, the kinds come in the
    order of KINDS. Columns other than doc_id and text are not read.
    """
    return docs.select("doc_id", secrets_column(F.col("text")).alias("__s")).select("doc_id", "__s.*")

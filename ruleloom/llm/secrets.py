"""Secret scans by assignment-aware lexing.

Plain patterns give the base spans (named assignments, access keys, long hex strings). On top, each text is
lexed as source code or configuration: names assigned to literals (name = "x", name: x, name => x,
--name x, name["x"] = "y", name: type = "x", triple quotes), with literals joined by + and names that stand for earlier literals (constants are propagated
through assignments). A literal is reported when the score of its target's name (how sensitive its words are)
and of the value (length, kinds of characters, entropy, no placeholder; of its longest token, if it has white space,
or a private key's header) reach LIMIT. Offsets are code points.

Edge cases: null text is empty; an empty text has no spans; texts, names and values are scanned whole, however long;
repeated rows are scanned each; spans that start together go by kind, then by end; an empty table gives no rows;
scan() replaces columns named base_spans and spans, redact() changes text and n_chars only, and other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.staging import small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: How much a word of a target's name tells that it holds a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "key": 0.5, "access": 0.4, "bearer": 0.9, "signature": 0.4, "salt": 0.5, "api": 0.3}
LIMIT = 1.0
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|example|placeholder|your[_-].*|none|null|true|false|undefined|<.*>|\$\{.*\}|\{\{.*\}\})$")
_PEM = re.compile("-----BEGIN [A-Z ]{0,32}PRIVATE KEY")
# name, operator, then a chain of literals and names
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
_LITERAL = r"\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|"
_LITERAL += r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`[^`\n]*+`"
_TARGET = re.compile(rf"(?<![A-Za-z0-9_.-])--({_NAME})[ \t]++(?=[\"'`A-Za-z0-9_$/+.])|(?:[\"']({_NAME})[\"'](?:[ \t]*\])?|(?<![A-Za-z0-9_.-])(?:--)?({_NAME}))[ \t]*(?::=|=>|==?|:)[ \t]*(?=[\"'`A-Za-z0-9_$/+.-])")
_TYPE = r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[(?:[^\[\]\n=:]++|\[[^\[\]\n=:]*+\])*+\]|<[^<>\n=:]*+>)?\??"
_ANNOTATION = re.compile(rf"{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+[ \t]*+=[ \t]*+(?=[\"'`])")
_BARE = re.compile(r"[A-Za-z0-9+/_.=$-]++")
_QUOTED = re.compile(_LITERAL)
_WORD = re.compile(_NAME)
#: Sums longer than this and than the text aren't kept as constants: they repeat a name over and over.
LONGEST_CONSTANT = 1 << 16
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?:\\?\n[ \t]*)?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HEX_CLASS = bytes(120 if (48 <= b <= 57 or 97 <= b <= 102) else 32 for b in range(256))
_RUN = b"x" * 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the plain patterns' matches."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def name_score(name: str) -> float:
    """Sum of the sensitive words of a name in snake, kebab or camel case, at most 1.5."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return min(1.5, sum(SENSITIVE.get(w, 0.0) for w in words) + (0.6 if "api" in words and "key" in words else 0.0))


def value_score(value: str) -> float:
    """0 for what can't be a secret, else up to 1 by length, kinds of characters and entropy."""
    return _score(_Value.of(value))


@dataclass
class _Value:
    """What a score needs of a value, however long: length, counts of characters, beginning and end.

    Of a text with white space they are those of its longest token.
    """

    n: int
    counts: Counter[str]
    head: str
    tail: str
    spaced: bool = False
    pem: bool = False

    @classmethod
    def of(cls, text: str) -> _Value:
        if (tokens := text.split()) != [text]:
            return replace(cls.of(max(tokens, key=len)) if tokens else cls(0, Counter(), "", ""), spaced=True, pem=bool(_PEM.search(text)))
        return cls(len(text), Counter(text), text[:16], text[-16:])

    def __add__(self, other: _Value) -> _Value:
        if self.spaced or other.spaced:
            return replace(max(self, other, key=lambda x: x.n), spaced=True, pem=self.pem or other.pem)
        return _Value(self.n + other.n, self.counts + other.counts, (self.head + other.head)[:16], (self.tail + other.tail)[-16:])


def _score(value: _Value) -> float:
    if value.pem:
        return 1.0
    n, chars = value.n, value.counts
    # all placeholders of over 16 characters show at their ends
    shown = value.head if n <= 16 else value.head + value.tail
    if n < 8 or PLACEHOLDERS.match(shown):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in chars.values())
    every = "".join(chars)
    kinds = bool(re.search("[a-z]", every)) + bool(re.search("[A-Z]", every)) + bool(re.search("[0-9]", every)) + bool(re.search("[^A-Za-z0-9]", every))
    return 0.0 if entropy < 2.0 or kinds < 2 else min(1.0, 0.15 * kinds + entropy / 8 + min(n, 40) / 100)


class _Runs:
    """Unquoted values; those that begin in one run of characters, one after the other, share one pass over it."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.counts = text, 0, 0, Counter()

    def value(self, at: int) -> tuple[_Value, int] | None:
        """The value from `at` to the end of its run, and that end; `at` never goes back."""
        if self.at <= at < self.end:
            self.counts.subtract(self.text[self.at : at])
        elif run := _BARE.match(self.text, at):
            self.end, self.counts = run.end(), Counter(run[0])
        else:
            return None
        self.at = at
        return _Value(self.end - at, +self.counts, self.text[at : min(self.end, at + 16)], self.text[max(at, self.end - 16) : self.end]), self.end


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of literals assigned to sensitive names, constants propagated.

    A literal bound to a plain name and later assigned to a sensitive one (password = DEFAULT) is reported where
    it stands. Parts joined with + are scored together and reported each.
    """
    known: dict[str, tuple[_Value, list[tuple[int, int]]]] = {}
    found: set[tuple[int, int]] = set()
    runs = _Runs(text)
    for m in _TARGET.finditer(text):
        name, at = m[1] or m[2] or m[3], m.end()
        # a name before the literal may be its type
        typed = _ANNOTATION.match(text, at) if text[m.start() : at].rstrip()[-1] == ":" else None
        at = typed.end() if typed else at
        value, parts = None, []
        while True:
            if literal := _QUOTED.match(text, at):
                quotes = 3 if text.startswith(('"""', "'''"), at) and literal.end() - at >= 6 else 1
                inside, end = (at + quotes, literal.end() - quotes), literal.end()
                more, new = _Value.of(text[slice(*inside)]), [inside]
            elif (other := _WORD.match(text, at)) and other[0] in known:
                (more, new), end = known[other[0]], other.end()
            elif value is None and (run := runs.value(at)):  # an unquoted value, as in configuration files
                value, end = run
                parts = [(at, end)]
                break
            else:
                break
            value = value + more if value else more
            parts = [*dict.fromkeys([*parts, *new])]
            if not (plus := _PLUS.match(text, end)):
                break
            at = plus.end()
        if value is None:
            continue
        if value.n <= max(LONGEST_CONSTANT, len(text)):
            known[name] = (value, parts)
        else:
            known.pop(name, None)
        if (score := name_score(name)) and score + (worth := _score(value)) >= LIMIT + 0.5 and worth > 0:
            found.update(p for p in parts if p[1] > p[0])
    return sorted(found)


def _may_match(text: str) -> tuple[bool, bool]:
    """Whether base patterns, and whether assignments to sensitive names, can occur; cheap tests of the whole text."""
    low = text.lower()
    named = any(w in low for w in ("pass", "secret", "token", "api", "pwd", "credential", "private", "auth", "key", "bearer", "signature", "salt"))
    return named or "AKIA" in text or _RUN in text.encode("utf-8", "replace").translate(_HEX_CLASS), named and ("=" in text or ":" in text or "--" in text)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans; a literal that lies in a base span adds nothing."""
    if not text:
        return [], []
    base_possible, named = _may_match(text)
    base = base_spans(text) if base_possible else []
    if not named:
        return base, base
    own = []
    at, covered = 0, sorted((a, b) for a, b, _ in base)
    for a, b in lexed_spans(text):
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if not any(x <= a and b <= y for x, y in covered[max(0, at - 1) : at + 2]):
            own.append((a, b, 3))
    return base, sorted(base + own, key=lambda x: (x[0], x[2], x[1])) if own else base


NAMES = (*KINDS, "literal")
SPANS = "array<struct<kind:string,start:long,end:long>>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """docs (any columns, among them text) with base_spans and spans, arrays of SPANS in order."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"base:{SPANS},spans:{SPANS}".join(("struct<", ">")))
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shape = lambda xs: [{"kind": NAMES[k], "start": a, "end": b} for a, b, k in xs]
        for batch in texts:
            found = [find(x) for x in batch]
            yield pd.DataFrame({"base": [shape(x) for x, _ in found], "spans": [shape(y) for _, y in found]}, index=batch.index)

    found = docs.withColumn("__found", spans("text"))
    return found.withColumns({"base_spans": F.col("__found.base"), "spans": F.col("__found.spans")}).drop("__found")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark; columns, order and null texts as before.

    Overlapping spans are replaced as one. n_chars, where present, follows the text.
    """
    small_batches(docs.sparkSession)

    def cut(text: str | None) -> str | None:
        _, spans = find(text)
        if not spans:
            return text
        out, at = [], 0
        for a, b, _ in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([cut(x) for x in batch], index=batch.index, dtype=object)

    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(docs: DataFrame) -> DataFrame:
    """What op8_secrets returns."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                base, spans = find(text)
                kinds = [k for *_, k in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"], index=batch.index)

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")

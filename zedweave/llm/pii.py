"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zedweave.llm.common import freed
from zedweave.llm.tokens import texts

#: Kinds in the order of spans; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "ssn", "url", "local_phone", "key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORDLIKE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?\s?[:=]\s?[\"']?([A-Za-z0-9_+/=.-]{8,})")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]*:[^\s/@]+@[A-Za-z0-9.-]+[^\s\"'<>]*")
_RUN = re.compile(r"[0-9]+")
_LOCAL_PHONE = re.compile(r"\(?([2-9][0-9]{2})(?:\)\x20?|[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_PEM = re.compile(r"[A-Z0-9\x20]{0,40}PRIVATE KEY-----")

#: Prefixes of issued keys, and how they go on.
_KEYS = {
    "AKIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ASIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ghp_": r"[A-Za-z0-9]{36,}", "gho_": r"[A-Za-z0-9]{36,}", "ghs_": r"[A-Za-z0-9]{36,}", "github_pat_": r"[A-Za-z0-9_]{22,}",
    "glpat-": r"[A-Za-z0-9_-]{20,}", "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "sk_live_": r"[A-Za-z0-9]{16,}", "AIza": r"[A-Za-z0-9_-]{35}", "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
}
_KEY = {k: re.compile(v) for k, v in _KEYS.items()}

#: Cues of identifiers; those in lower case are found in either case.
_SECRETS = ("password", "passwd", "api_key", "apikey", "api-key", "secret_key", "access_token", "auth_token", "client_secret", "token", "secret")
_IBANS = ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for key, value in [("@", "@"), ("+", "+"), ("://", "url"), *((str(d), "digit") for d in range(10))]:
        a.add_word(key, (value, len(key)))
    for s in _SECRETS:
        for k in (s, s.upper(), s.capitalize()):
            a.add_word(k, ("secret", len(k)))
    for s in _KEYS:
        a.add_word(s, ("key", len(s)))
    a.add_word("-----BEGIN ", ("pem", 11))
    for s in _IBANS:
        for d in range(10):
            a.add_word(f"{s}{d}", ("iban", 3))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_ip(s: str) -> bool:
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in s.split(".")))


def is_iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in code points, ascending and disjoint within a kind.

    A kind's parser begins at its anchors from left to right, never within a match that it has made,
    kept or dropped: that is what a scan of the whole text for leftmost matches finds.
    """
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    out: dict[str, list[tuple[int, int]]] = {}
    email = ip = card = phone = run = other = local = key = 0  # where each kind may begin
    for end, (kind, n) in _AUTOMATON[0].iter(text):
        p = end - n + 1
        if kind == "digit":
            if p < run:
                continue
            m = _RUN.match(text, p)
            run = m.end()
            nxt = text[run : run + 2]
            if p >= ip and nxt[:1] == "." and (m := _IP.match(text, p)):
                ip = m.end()
                if is_ip(m[0]):
                    out.setdefault("ip", []).append(m.span())
            if run - p == 3 and p >= local and (not p or text[p - 1] not in _WORDLIKE and text[p - 1] not in "+-.") and (m := _LOCAL_PHONE.match(text, p - (text[p - 1 : p] == "("))):
                local = m.end()
                if p >= phone:  # else it is part of a longer one
                    out.setdefault("local_phone", []).append(m.span())
            if p < card or run - p < 2 and not (nxt[:1] in " -" and nxt[1:].isdigit() and nxt[1:].isascii()):
                continue
            m = _CARD.match(text, p)
            if m is None:
                continue
            card = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.setdefault("card", []).append(m.span())
            elif (m := _SSN.match(text, p)) and text[p - 1 : p] not in ("-", ".") and p >= other and (not p or text[p - 1] not in _WORDLIKE):
                out.setdefault("ssn", []).append(m.span())
        elif kind == "@":
            s = p
            while s > email and text[s - 1] in _LOCAL:
                s -= 1
            if s < p and (m := _DOMAIN.match(text, p + 1)):
                email = m.end()
                out.setdefault("email", []).append((s, email))
        elif kind == "+":
            if p >= phone and (m := _PHONE.match(text, p)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.setdefault("phone", []).append(m.span())
        elif kind == "secret":
            if m := _SECRET.match(text, end + 1):
                if any(c.isdigit() for c in m[1]) and m.start(1) >= (out["secret"][-1][1] if "secret" in out else 0):
                    out.setdefault("secret", []).append(m.span(1))
        elif kind == "key":
            if p >= key and (not p or text[p - 1] not in _WORDLIKE) and (m := _KEY[text[p : end + 1]].match(text, end + 1)):
                key = m.end()
                out.setdefault("key", []).append((p, key))
        elif kind == "pem":
            if p >= key and (m := _PEM.match(text, end + 1)) and (at := text.find("-----END ", m.end(), m.end() + 20_000)) >= 0 and (m := _PEM.match(text, at + 9)):
                key = m.end()
                out.setdefault("key", []).append((p, key))
        elif kind == "iban":
            if (not p or text[p - 1] not in _WORDLIKE) and (m := _IBAN.match(text, p)):
                s = m[0]
                if not is_iban(s) and " " in s:  # the next word may have been taken for a part
                    s = s.rpartition(" ")[0]
                if is_iban(s) and p >= (out["account"][-1][1] if "account" in out else 0):
                    out.setdefault("account", []).append((p, p + len(s)))
        elif (m := _USERINFO.match(text, end + 1)) and p >= other:
            s = p
            while s > other and text[s - 1] in _WORDLIKE:
                s -= 1
            other = m.end()
            out.setdefault("url", []).append((s, other))
    return out


def written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans.get(k, ()))


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """text with a mark of its kind for each span; overlapping spans become one, of the first's kind."""
    parts, at = [], 0
    for s, e, k in sorted((s, e, k) for k in spans for s, e in spans[k]):
        if s >= at:
            parts += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t) for _, t in texts([batch])]
        base = [written(f, KINDS[:4]) for f in found]
        columns = [pa.array([len(f.get(k, ())) for f in found], pa.int64()) for k in KINDS[:4]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([written(f) for f in found], pa.string())],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of their spans, and all spans.

    Null texts are empty and have no spans; ids may be null or repeat, repeated rows give equal rows, an empty table an
    empty result. Whole texts are read, in one pass each; columns of other names are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: freed(_find(b)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from freed(pd.Series([None if t is None else redacted(t, find(t)) for t in s], dtype=object) for s in series)


def _clean(text: Column) -> Column:
    return F.pandas_udf(_redact, "string", F.PandasUDFType.SCALAR_ITER)(text)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with marks in place of personal data, the length column kept in step.

    Null texts stay null, empty ones empty, and texts without findings as they are. Repeated rows give equal rows; ids aren't
    looked at; columns of other names, null or not, are returned as they are. Empty table: empty result.
    """
    out = docs.withColumn(text_col, _clean(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out

"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus-digit pairs, URL schemes and identifier cues. At each
anchor a deterministic local parser expands to the boundaries of an email, address or account and validates it. Text
without anchors costs nothing but the pass.

Base kinds follow the leftmost non-overlapping matches, per kind, of the patterns below; a match that fails its check is
dropped and not retried. ``url`` and ``account`` come on top. Spans are (kind, start, end) in code points, end exclusive.
Nulls and empty texts have no spans; repeated rows are scanned each; only ``text`` is read.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import by_batch, mapped_text, pick, sha, table

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"""[^\s"'<>(){}\[\]]{4,}""")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "postgres://", "mysql://")
CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "iban", "account", "acct", "ssn", "passport")
#: What may stand between a cue and its value, then the value.
VALUE = re.compile(r"""(?:[ \t]*(?:number|no\.?|id))?[ \t]*[:=#][ \t]*["']?([A-Za-z0-9][A-Za-z0-9_/+.-]{7,})|[ \t]+(?:number[ \t]+|no\.?[ \t]+)?["']?([A-Z]{0,2}[0-9][A-Z0-9-]{7,})""")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def automaton() -> ahocorasick.Automaton:
    """Anchors with their parser's name and length. Cues are taken in lower, upper and title case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word(f"+{d}", ("plus", 2))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.title()}:
            found.add_word(form, ("cue", len(c)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return bool(IBAN.fullmatch(value)) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account(value: str) -> bool:
    """Does a value behind a cue look like an identifier: an IBAN, an SSN, or long with enough digits?"""
    return iban(value) or bool(SSN.fullmatch(value)) or (len(value) >= 8 and sum(c in DIGITS for c in value) >= 4)


def spans(anchors: ahocorasick.Automaton, text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed in ``KINDS``, then start."""
    text = text or ""
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)

    def keep(kind: str, start: int, stop: int, good: bool = True) -> None:
        past[kind] = stop
        if good:
            found[kind].append((kind, start, stop))

    for end, (what, size) in anchors.iter(text):
        at = end - size + 1
        if what == "digit":
            if at and text[at - 1] in DIGITS:
                continue
            if at >= past["ip"] and (m := IP.match(text, at)):
                keep("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
            if at >= past["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                keep("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif what == "at":
            lo = at
            while lo > past["email"] and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", lo, m.end())
        elif what == "plus":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                keep("phone", at, m.end(), 9 <= sum(c in DIGITS for c in m[0]) <= 15)
        elif what == "scheme":
            if at >= past["url"] and (m := URL.match(text, end + 1)):
                keep("url", at, end + 1 + len(m[0].rstrip(".,;:!?")))
        elif (not at or not text[at - 1].isalnum()) and (m := VALUE.match(text, end + 1)):
            which = 1 if m[1] else 2
            value = m[which].rstrip(".-")
            if m.start(which) >= past["account"] and account(value):
                keep("account", m.start(which), m.start(which) + len(value))
    return [s for k in KINDS for s in found[k]]


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def digests(anchors, keys: list, texts: list):
    for key, text in zip(keys, texts, strict=True):
        found = spans(anchors, text)
        base = [s for s in found if s[0] in BASE]
        yield (key, *(sum(s[0] == k for s in base) for k in BASE), sha(written(base).encode()), written(found))


def find(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans of every whole text."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return by_batch(pick(docs, "doc_id", "text"), digests, schema, "doc_id", "text", ready=automaton)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def masks(anchors, keys: list, texts: list):
    for key, text in zip(keys, texts, strict=True):
        yield key, text if text is None else masked(text, spans(anchors, text))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind; ``n_chars`` follows the new text."""
    return mapped_text(docs, masks, ready=automaton)

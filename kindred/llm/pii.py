r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, a plus before a digit, a digit before a dot, two
digits with or without a separator between them, and identifier cues (account, iban, user id and the like). From each
anchor a deterministic parser expands to the left and right, and validates what it took: email, ip, card (Luhn), phone,
and besides these base kinds url (with user information), and account (the value after a cue).

Spans are code points, end exclusive. Each parser takes what the leftmost, non-overlapping match of its pattern takes;
a match that fails its check is dropped and not retried. Defined results: a null or empty text has no spans; spans of
different kinds may overlap; the order is by kind as listed, then start; repeated rows are scanned each; masking
replaces the union of overlapping spans once, by its first kind; other columns are carried by mask() only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.spans import Span, find_spans

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
_DIGITS = "0123456789"
_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~%+-]+(?::[^\s@/]*)?@[^\s\"'<>]+")
_LED = r"[\"']?\x20{0,4}(?:[:=#]|(?:no|nr|number)\b\.?:?)\x20{0,4}[\"']?"
#: Groups of four after a country and check digits, as bank account numbers are printed; else a run with spaces before digits.
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9]))+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?"
_VALUE = re.compile(rf"{_LED}({_IBAN}|[A-Z0-9](?:[A-Z0-9-]|\x20(?=[0-9]))*[A-Z0-9])")
_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "iban", "IBAN", "passport", "Passport", "ssn", "SSN", "customer id", "Customer ID", "user id", "User ID")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def automaton():
    """Anchors: (kind, length of the anchor)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in _DIGITS:
        a.add_word("+" + d, ("phone", 2))
        a.add_word(d + ".", ("ip", 2))
    for x in _DIGITS:
        for y in _DIGITS:
            for sep in ("", " ", "-"):
                a.add_word(x + sep + y, ("card", 2 + len(sep)))
    a.add_word("://", ("url", 3))
    for cue in _CUES:
        a.add_word(cue, ("account", len(cue)))
    a.make_automaton()
    return a


def _run_start(text: str, at: int, floor: int) -> int:
    """Start of the run of digits that ends before at."""
    while at > floor and text[at - 1] in _DIGITS:
        at -= 1
    return at


def expand(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Validated spans of each kind; anchors are (end index inclusive, (kind, length)) in order of their ends."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for end, (kind, length) in anchors:
        at = end + 1 - length
        if at < done[kind]:
            if kind != "card" or end < done[kind]:
                continue
        if kind == "email":
            left = at
            while left > done[kind] and text[left - 1] in _LOCAL:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                found[kind].append((left, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            left = _run_start(text, at + 1, done[kind])
            if m := _IP.match(text, left):
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                    found[kind].append(m.span())
                done[kind] = m.end()
        elif kind == "card":
            m = _CARD.match(text, max(at, done[kind]))
            if m:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found[kind].append(m.span())
                done[kind] = m.end()
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found[kind].append(m.span())
                done[kind] = m.end()
        elif kind == "url":
            left = at
            while left > done[kind] and text[left - 1].isascii() and text[left - 1].isalpha():
                left -= 1
            if left < at and (m := _URL.match(text, end + 1)):
                found[kind].append((left, m.end()))
                done[kind] = m.end()
        elif (m := _VALUE.match(text, end + 1)) and len(m[1]) >= 6 and sum(c in _DIGITS for c in m[1]) >= 4:
            found[kind].append(m.span(1))
            done[kind] = m.end()
    return found


def finder(mask: bool) -> Callable[[str], tuple[list[Span], list[Span], str]]:
    a = automaton()

    def find(text: str) -> tuple[list[Span], list[Span], str]:
        if not text:
            return [], [], text
        by = expand(text, a.iter(text))
        base = [(k, *s) for k in BASE for s in by[k]]
        spans = base + [(k, *s) for k in KINDS[len(BASE) :] for s in by[k]]
        return base, spans, masked(text, spans) if mask and spans else text

    return find


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by <KIND> of its first span."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a < last:
            last = max(last, b)
            at = last
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = last = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (kind:start:end, comma-joined) of every document."""
    return find_spans(docs, lambda: finder(False), BASE)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with the personal data in their texts masked and n_chars, where there is one, brought up to date; a null text stays null."""
    keep = tuple(c for c in docs.columns if c != "text")
    out = find_spans(docs, lambda: finder(True), BASE, keep=keep, text_out=True)
    made = {c: F.col(f"_k{i}") for i, c in enumerate(keep)} | {"text": F.col("text")}
    if "n_chars" in keep:
        made["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(made[c].alias(c) for c in docs.columns))

r"""Secret scan with multipart credential linking.

Strong findings need no company: assignments to a secret's name, access key ids, long hex strings. Besides these, weak
parts are looked for: identifiers (user, client or account ids given as key and value, key ids too short to be strong),
secrets (mixed strings of 20 characters and more with high entropy) and endpoints (URLs, host:port). A weak part is
reported only when it co-occurs with a complementary part - an identifier or an endpoint with a secret - within a scope:
the paragraph it stands in (a blank line ends one, whatever the line ends), and at most `reach` code points away. The path
of a URL is part of the endpoint and no secret; what follows its "?", "#", "@" or a ":" may be one. Scopes are intervals of one document, so the
interval join is a sweep over that document's parts in order of their positions; nothing is shuffled.

Spans are code points, end exclusive. Defined results: a null or empty text has no spans; a match overlapping one of its
own kind is not reported; a weak part inside a base span is that span and no second one; on equal starts the order is
assign, access, hex, ident, key, endpoint; repeated rows are scanned each; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame

from kindred.llm.spans import Span, find_spans

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = KINDS[:3]


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Each name holds one of these; most texts hold none, which is seen without the pattern.
_CUES = re.compile("[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK]")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}+")
_HEXISH = re.compile(r"[0-9a-f]{32}")
IDENT = re.compile(r"""(?:[uU]ser(?:name|_?id)?|[lL]ogin|[cC]lient_?id|[aA]ccount_?id|[aA]ccess_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,15}://[^\s"'<>]{3,}|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+:[0-9]{2,5}(?![0-9])""")
_PARA = re.compile(r"\n[\x20\t\r]*\n")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20}")
#: A text without these has neither base spans nor weak secrets, and so no spans at all.
CUES = r"(?i:passw|secret|token|api_?k)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{20}"


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, by start and then kind."""
    out: list[Span] = []
    if _CUES.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEXISH.search(text):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in (value.count(x) for x in set(value)))


def mixed(value: str) -> bool:
    """Upper and lower case and digits, as random keys have and words have not."""
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def linked(text: str, base: list[Span], reach: int, bits: float) -> list[Span]:
    """Weak parts with a complementary part in their scope."""
    secrets = [s for s in base if s[0] != "access"]
    weak_secrets: list[Span] = []
    endpoints: list[Span] = []
    if _LONG.search(text):
        weak_secrets = [("key", m.start(), m.end()) for m in KEY.finditer(text) if mixed(m[0]) and entropy(m[0]) >= bits]
    if not secrets and not weak_secrets:
        return []
    if ":" in text:
        endpoints = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
        heads = [a for _, a, _ in endpoints]

        def in_path(a: int) -> bool:
            at = bisect_left(heads, a + 1) - 1
            return at >= 0 and a < endpoints[at][2] and text[a - 1] != ":" and not any(c in text[heads[at] : a] for c in "?#@")

        weak_secrets = [s for s in weak_secrets if not in_path(s[1])]
        if not secrets and not weak_secrets:
            return []
    partners: list[Span] = [("ident", m.start(1), m.end(1)) for m in IDENT.finditer(text)] + endpoints
    partners += [("ident", m.start(), m.end()) for m in ACCESS.finditer(text) if 8 <= m.end() - m.start() < 16]
    strong_ids = [s for s in base if s[0] == "access"]
    breaks = [m.start() for m in _PARA.finditer(text)]

    def near(parts: list[Span], others: list[Span]) -> list[Span]:
        """Those of parts with one of others in the same scope: a sweep over both, sorted by start."""
        others = sorted(others, key=lambda s: s[1])
        starts = [s[1] for s in others]
        longest = [0]
        for s in others:
            longest.append(max(longest[-1], s[2]))
        out = []
        for s in parts:
            scope = bisect_left(breaks, s[1])
            low = max(s[1] - reach, breaks[scope - 1] if scope else 0)
            high = min(s[2] + reach, breaks[scope] if scope < len(breaks) else len(text))
            first, last = bisect_left(starts, low), bisect_left(starts, high)
            if last > first or longest[first] > low:
                out.append(s)
        return out

    found = near(weak_secrets, partners + strong_ids) + near(partners, secrets + weak_secrets)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    most = [0]
    for _, b in taken:
        most.append(max(most[-1], b))
    return [s for s in found if most[bisect_left(starts, s[2])] <= s[1]]


def finder(reach: int, bits: float, mark: str | None) -> Callable[[str], tuple[list[Span], list[Span], str]]:
    def find(text: str) -> tuple[list[Span], list[Span], str]:
        base = base_spans(text)
        spans = base
        if more := linked(text, base, reach, bits):
            spans = sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return base, spans, text

    return find


def scan(docs: DataFrame, *, reach: int = 400, bits: float = 3.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end, comma-joined) of every document."""
    return find_spans(docs, lambda: finder(reach, bits, None), BASE, cues=CUES)

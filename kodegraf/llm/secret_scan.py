"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Three patterns give the base spans. Beyond them, whatever stands behind a
credential word and a separator is priced as a password: a dynamic programme
finds the cheapest segmentation into common words, dates, repeats, keyboard
walks and brute-force characters, in powers of ten of guesses. Common words are
a short list of passwords and placeholders, and then the words of a public
tokenizer's vocabulary, whose ids follow how common they are; walks and repeats
are taken as maximal runs. Values from 10**8 guesses on, which an attack on a
running service does not try, are reported as kind `guess`; placeholders and
words of prose are not. A quoted value is read to its closing quote on the line.
All scans take time in proportion to the text (but for a logarithm).

Edge cases: null texts count as empty and have no spans; texts are read whole;
repeated rows get a row each; an empty table gives no rows. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import Spans, map_texts, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ finds them, of which short ones drop
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")
#: Credential words before a value.
CONTEXT = re.compile(
    r"""(?:passphrase|passcode|password|passwd|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|authorization|bearer|login)["']?[\x20\t]*+"""
    r"""(?:=>|:=|[:=])[\x20\t]*+(?:(?:bearer|basic)[\x20\t]++)?(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([^\s"'<>,;]{6,}))""",
    re.I | re.A,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
#: Values from 10**8 guesses on are reported.
LEAST_COST = 8.0
#: Common words in passwords and placeholders, the commonest first (fixed values).
WORDS = (
    "password pass admin root user test login welcome master secret hello love dragon monkey football baseball "
    "princess sunshine shadow letmein changeme default example sample dummy placeholder your here token key value "
    "string null none true false undefined public private access service system server database db my the and "
    "summer winter spring autumn january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday company office home work dev prod stage demo temp "
    "guest super qwerty iloveyou batman superman michael jordan charlie daniel thomas hunter killer trust freedom"
).split()
#: Words of the vocabulary that count: letters only, of this many characters.
WORD_LENGTHS = (3, 16)
#: Rows of the keyboard, the alphabet and the digits: walks go along them, either way.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:19|20)\d\d", re.A)
SEGMENT = 0.3  # order of segments, a factor of two each


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[str, int]:
    """Rank of each common word: WORDS, then the whole words of a vocabulary in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    low, high = WORD_LENGTHS
    whole = [w for x in sorted(vocabulary, key=vocabulary.get) if x.endswith("</w>") and low <= len(w := x[:-4]) <= high and w.isalpha()]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *whole]))}


@lru_cache(maxsize=1)
def _next_keys() -> frozenset[tuple[str, str]]:
    pairs = {p for row in WALKS for p in zip(row, row[1:])}
    return frozenset(pairs | {(b, a) for a, b in pairs})


def _class_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if c.isascii() else 1000)


def segments(value: str, rank: dict[str, int]) -> dict[int, list[tuple[int, float]]]:
    """By end, the start and log10 of the guesses of each word, date, keyboard walk and repeat."""
    n = len(value)
    plain = value.lower()
    if len(plain) != n:  # a character whose lower case is longer
        plain = value
    leet = plain.translate(LEET)
    found: dict[int, list[tuple[int, float]]] = {}

    def add(i: int, j: int, cost: float) -> None:
        found.setdefault(j, []).append((i, cost))

    for i in range(n):
        for j in range(i + 2, min(n, i + WORD_LENGTHS[1]) + 1):
            for text, extra in ((plain, 0.0), (leet, 0.3)):
                if (place := rank.get(text[i:j])) is not None:
                    add(i, j, math.log10(place + 1) + extra + (0.3 if value[i:j] != text[i:j] else 0.0))
    for m in DATE.finditer(value):
        add(m.start(), m.end(), math.log10(120) if m.end() - m.start() == 4 else math.log10(120 * 365))
    keys, i = _next_keys(), 0
    while i < n - 1:  # keyboard walks: maximal runs of neighbouring keys
        j = i
        while j + 1 < n and (plain[j], plain[j + 1]) in keys:
            j += 1
        if j - i >= 2:
            add(i, j + 1, math.log10(40 * (j - i + 1)))
        i = max(j, i + 1)
    for period in (1, 2, 3, 4):  # repeats: maximal runs of one period
        i = 0
        while i + period < n:
            j = i
            while j + period < n and value[j] == value[j + period]:
                j += 1
            if j - i >= max(2, period):
                add(i, j + period, sum(map(_class_cost, value[i : i + period])) + math.log10((j - i) / period + 1))
            i = max(j, i + 1)
    return found


def guess_cost(value: str, path: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    n, found = len(value), segments(value, ranks(path or public_path()))
    # The cheapest way to each place whose last segment is brute force, and whose last one is another.
    brute, known = [math.inf] * (n + 1), [math.inf] * (n + 1)
    known[0] = 0.0
    for j in range(1, n + 1):
        # A brute-force span grows by a character; only its first one opens a segment.
        brute[j] = min(brute[j - 1], known[j - 1] + SEGMENT) + _class_cost(value[j - 1])
        known[j] = min((min(brute[i], known[i]) + cost + SEGMENT for i, cost in found.get(j, ())), default=math.inf)
    return min(brute[n], known[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, base: list[tuple[int, int, int]], path: str | None = None) -> list[tuple[int, int, int]]:
    """Dear values in credential contexts that the base spans don't cover whole."""
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    covered, out = Spans((s, e) for s, _, e in base), []
    for m in CONTEXT.finditer(text):
        quoted = m[3] is None
        value = m[1] or m[2] or m[3]
        i = m.start(m.lastindex)
        value = value if quoted else value.rstrip(".)]}")
        j = i + len(value)
        if value and not covered.hold(i, j) and guess_cost(value, path) >= LEAST_COST:
            out.append((i, 3, j))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in sorted(spans))


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess; path: the vocabulary of common words."""
    path = path or public_path()

    def make():
        def run(batch):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")}
            for text in texts_of(batch):
                base = base_spans(text)
                more = guessed_spans(text, base, path)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                out["n_guess"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
            return out | {"doc_id": batch.column("doc_id")}

        return run

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return map_texts(docs, make, schema, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])

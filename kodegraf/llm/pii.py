"""Personal data: fixed patterns, and candidates judged by boosted trees.

Four patterns give the base spans. Generators of high recall propose further,
overlapping spans: written-out e-mail addresses, local phone numbers, social
security numbers, bank accounts, IPv6 addresses, card numbers of other lengths,
birth dates. Gradient-boosted trees judge each by its format and its context;
the scores are calibrated, and per kind a threshold is set at which redactions
are right on held-out examples. Of overlapping ones the likelier stays; none
overlaps a base span.

No table labels personal data, so the trees are trained on examples made by
rule: spans of each kind and look-alikes (order numbers, versions, dates,
measures) in random sentences. Their precision holds for such examples; it says
nothing about other texts.

Edge cases: null texts count as empty and have no spans; texts are read whole,
in time proportional to their length (but for a logarithm); repeated rows get a row each; an empty
table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import Spans, map_texts, texts_of

BASE = ("email", "ip", "card", "phone")
MORE = ("mail_words", "phone_local", "ssn", "iban", "ipv6", "card_other", "birth")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit before would make the same attempt fail or succeed one place earlier.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GENERATORS = {
    "mail_words": re.compile(r"(?<![\w.])[A-Za-z0-9_+-]{1,64}(?:\.[A-Za-z0-9_+-]{1,64}){0,4}\x20{0,2}[(\[{]\x20?at\x20?[)\]}]\x20{0,2}[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]{2,64}){1,4}", re.I),
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3,5}(?:[\x20.-][0-9]{2,5}){0,3}(?![\w])"),
    "ssn": re.compile(r"(?<![\w.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    "card_other": re.compile(r"(?<![0-9+.-])[0-9]{4}[\x20-]?[0-9]{4,6}[\x20-]?[0-9]{4,5}(?![\w-])"),
    "birth": re.compile(r"(?<![\w.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![\w-])"),
}
#: Words near a span that speak for its kind, and such that speak against any (fixed values).
FOR = {
    "mail_words": "mail email e-mail contact write reach",
    "phone_local": "phone tel telephone call mobile cell fax whatsapp telefon",
    "ssn": "ssn social security",
    "iban": "iban account bank transfer konto",
    "ipv6": "ip address host server client addr",
    "card_other": "card visa mastercard amex credit payment karte",
    "birth": "born birth dob birthday birthdate geboren",
}
FOR = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")\b", re.I) for k, v in FOR.items()}
AGAINST = re.compile(r"\b(?:order|invoice|isbn|issn|version|serial|ref|reference|no|number|id|item|sku|model|page|pages|article|released|updated|published|score|ratio|total|mac|time|at)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them: from each @ to the start of its run of local characters, in linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > free and text[i - 1] in LOCAL:
            i -= 1
        m = DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
        free = m.end() if m else at + 1  # no local part reaches back over an @
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), sorted."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return sorted(out)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators; they may overlap."""
    names = [k for k in MORE if k not in ("mail_words",)] if DIGIT.search(text) else []
    names += ["mail_words"] if re.search(r"[(\[{]\x20?at\x20?[)\]}]", text, re.I) else []
    names += ["ipv6"] if "ipv6" not in names and "::" in text else []
    return [(k, *m.span()) for k in names for m in GENERATORS[k].finditer(text)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def measured(text: str, kind: str, i: int, j: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[i:j]
    digits = _digits(s)
    left, right = text[max(0, i - 40) : i], text[j : j + 24]
    groups = re.findall(r"[0-9]+", s)
    valid = {"iban": lambda: iban_ok(s), "card_other": lambda: luhn(digits), "ssn": lambda: groups[0] not in ("000", "666") and groups[0] < "900" and groups[1] != "00" and groups[2] != "0000"}.get(kind, lambda: False)()
    return [
        *(float(kind == k) for k in MORE),
        len(s), len(digits), len(groups), float(max(map(len, groups), default=0)), float(valid),
        sum(not c.isalnum() for c in s), float("(" in s), float("." in s), float("/" in s), float(s.startswith("0")),
        max((digits.count(c) for c in set(digits)), default=0) / max(1, len(digits)),
        float(bool(FOR[kind].search(left))), float(bool(FOR[kind].search(right))), float(bool(AGAINST.search(left[-16:]))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left.rstrip()[-1:] in (":", "=")),
    ]


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, left feature, left cut, right feature, right cut, four leaves)."""

    nodes: list[tuple]
    offset: float
    slope: float
    shift: float
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.offset)
        for f, c, fl, cl, fr, cr, leaves in self.nodes:
            left = x[:, f] <= c
            inner = np.where(left, x[:, fl] <= cl, x[:, fr] <= cr)
            z += np.asarray(leaves)[2 * ~left + ~inner]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def _stump(x, g, h, rows, cuts):
    best = (-1.0, 0, np.inf)
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f, at in enumerate(cuts):
        for c in at:
            left = x[rows, f] <= c
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 9)))[:-1] if len(np.unique(x[:, f])) > 9 else np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
    offset = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, nodes = np.full(len(y), offset), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, c = _stump(x, g, h, np.arange(len(y)), cuts)
        left = x[:, f] <= c
        (fl, cl), (fr, cr) = (_stump(x, g, h, np.flatnonzero(side), cuts) for side in (left, ~left))
        inner = np.where(left, x[:, fl] <= cl, x[:, fr] <= cr)
        leaf = 2 * ~left + ~inner
        leaves = [rate * g[leaf == k].sum() / (h[leaf == k].sum() + 1) for k in range(4)]
        nodes.append((f, c, fl, cl, fr, cr, leaves))
        z += np.asarray(leaves)[leaf]
    return Trees(nodes, offset, 1.0, 0.0, {})


def examples(n: int, seed: int) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """(text, kind, start, end) made by rule, half of them look-alikes, and 1 for personal data."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *a: a[rng.integers(len(a))]

    def card(k):
        d = pick("34", "37", "30", "36") + num(k - 3)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def iban():
        country, body = pick("DE", "FR", "GB", "ES", "NL"), num(18)
        return next(s for k in range(2, 99) if iban_ok(s := f"{country}{k:02d}{body}"))

    def spaced(s):
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    good = {
        "mail_words": lambda: f"{word()}.{word()} {pick('(at)', '[at]', '( at )')} {word()}{pick('.', ' (dot) ', ' [dot] ')}{pick('com', 'org', 'net', 'de')}",
        "phone_local": lambda: pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)}/{num(5)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"),
        "ssn": lambda: f"{rng.integers(100, 665)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        "iban": lambda: spaced(iban()),
        "ipv6": lambda: ":".join(f"{rng.integers(1, 65535):x}" for _ in range(8)),
        "card_other": lambda: (lambda c: pick(c, f"{c[:4]} {c[4:10]} {c[10:]}"))(card(15)),
        "birth": lambda: pick(f"19{rng.integers(40, 99)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", f"{rng.integers(1, 28)}.{rng.integers(1, 12)}.19{rng.integers(40, 99)}"),
    }
    bad = {
        "mail_words": lambda: f"{word()} (at) {word()}.{word()}",
        "phone_local": lambda: pick(f"{num(3)} {num(3)}", f"{num(3)}-{num(3)}", f"0{num(1)} {num(3)}", f"{num(3)}.{num(3)}"),
        "ssn": lambda: f"{pick('000', '666', '912')}-{num(2)}-{num(4)}",
        "iban": lambda: f"{pick('AB', 'XY', 'PO')}{num(2)} {num(4)} {num(4)}",
        "ipv6": lambda: f"{rng.integers(10, 24)}:{rng.integers(10, 59)}:{rng.integers(10, 59)}",
        "card_other": lambda: num(pick(13, 14, 15)),
        "birth": lambda: f"20{rng.integers(10, 25)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}",
    }
    hints = {k: v.pattern[5:-3].split("|") for k, v in FOR.items()}
    rows, y = [], []
    while len(y) < n:
        kind, right = MORE[rng.integers(len(MORE))], rng.random() < 0.5
        span = (good if right or rng.random() < 0.3 else bad)[kind]()
        # A good format without a word for it is personal data only where the format alone tells.
        told = rng.random() < 0.7 if right else False
        if right and not told and kind in ("birth", "ipv6", "phone_local") and "(" not in span:
            told = True
        lead = pick(*hints[kind]) if told else (pick("order", "version", "ref", "updated", "invoice", "item") if not right else word())
        sure = right or (kind in ("ssn", "iban", "mail_words") and lead not in ("order", "version", "ref", "updated", "invoice", "item"))
        before = f"{word()} {word()} {lead}{pick('', ':', ' is', '')} "
        text = before + span + pick(" ", ", ", ". ") + word()
        m = next((m for m in GENERATORS[kind].finditer(text) if m.start() < len(before) + len(span) and m.end() > len(before)), None)
        if m:
            rows.append((text, kind, m.start(), m.end()))
            y.append(float(sure))
    return rows, np.array(y)


#: Precision that the threshold of a kind keeps on held-out examples.
PRECISION = 0.98


def fit(n: int = 2000) -> Trees:
    measure = lambda rows: np.array([measured(*r) for r in rows])
    rows, y = examples(n, 1)
    trees = boost(measure(rows), y)
    rows, y = examples(n // 2, 2)
    raw = trees.raw(x := measure(rows))
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's scaling
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a -= 0.05 * float(np.mean((p - y) * raw))
        b -= 0.05 * float(np.mean(p - y))
    trees.slope, trees.shift = a, b
    p = trees.probability(x)
    kinds = np.array([r[1] for r in rows])
    for k in MORE:
        own = kinds == k
        fits = [t for t in np.linspace(0.5, 0.99, 50) if (hit := own & (p >= t)).any() and y[hit].mean() >= PRECISION]
        trees.thresholds[k] = float(min(fits, default=1.1))
    return trees


def more_spans(text: str, base: list[tuple[int, int, int]], trees: Trees) -> list[tuple[int, int, int]]:
    """Judged candidates, the likelier of overlapping ones, none over a base span; kind numbers follow the base kinds."""
    over = Spans((i, j) for _, i, j in base)
    found = [c for c in candidates(text) if not over.meet(c[1], c[2])]
    if not found:
        return []
    p = trees.probability(np.array([measured(text, *c) for c in found]))
    likely = sorted((-q, i, j, MORE.index(kind)) for q, (kind, i, j) in zip(p, found) if q >= trees.thresholds[kind])
    starts: list[int] = []  # of the spans taken so far, which don't overlap
    end: dict[int, int] = {}
    out: list[tuple[int, int, int]] = []
    for _, i, j, kind in likely:
        k = bisect_left(starts, j)
        if k == 0 or end[starts[k - 1]] <= i:
            insort(starts, i)
            end[i] = j
            out.append((len(BASE) + kind, i, j))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = BASE + MORE
    return ",".join(f"{names[k]}:{i}:{j}" for k, i, j in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more."""
    trees = docs.sparkSession.sparkContext.broadcast(fit())

    def make():
        def run(batch):
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more")}
            for text in texts_of(batch):
                base = base_spans(text)
                more = more_spans(text, base, trees.value)
                for k, name in enumerate(BASE):
                    out[f"n_{name}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
                out["n_more"].append(len(more))
            return out | {"doc_id": batch.column("doc_id")}

        return run

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long"
    return map_texts(docs, make, schema, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of their texts replaced by its kind in brackets; n_chars, if there, follows the text."""
    trees = docs.sparkSession.sparkContext.broadcast(fit())
    names = BASE + MORE

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            out, end = [], 0
            for i, j, k in sorted((i, -j, k) for k, i, j in base + more_spans(text, base, trees.value)):
                if -j > end:
                    out += [text[end:i], f"[{names[k].upper()}]"]
                    end = -j
            return "".join(out) + text[end:]

        return texts.map(one)

    new = docs.withColumn("text", clean(F.col("text").cast("string")))
    return new.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])

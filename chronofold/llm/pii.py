"""Personal data: pattern spans, and more spans chosen by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Beside them,
generous generators propose further candidates, which may overlap one another: spans
of neighbouring digit groups, long mixed strings, and account-like codes. Boosted trees score each
candidate by its format and by the words around it; a kind's candidates are kept from its
calibrated threshold on, and of overlapping ones the likeliest is. The trees are trained
on examples that are generated here, from a fixed seed: formats of personal data and of
harmless numbers (dates, prices, versions, checksums, measures) in varied contexts. Their
margins become probabilities by Platt scaling, kind by kind, on lines of another generator
(other words, other sentences, other languages), and a kind's threshold is the smallest
probability that reaches the wanted precision on further lines of it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import released, small, text_of

BASE = ("email", "ip", "card", "phone")
MORE = ("account", "code", "local_phone", "secret")
KINDS = BASE + MORE
_ORDER = {k: n for n, k in enumerate(KINDS)}
PRECISION = 0.99

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRACE = re.compile(r"[0-9@+]")

# Candidates: digit groups, long mixed strings, codes of two letters and digits.
_GROUPS = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_LEFT = re.compile(r"([0-9]+)([\x20().\-/]{1,2})$")
_RIGHT = re.compile(r"([\x20().\-/]{1,2})([0-9]+)")
_MIXED = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
_CODE = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}\b")
# How the keys of well-known services begin.
_PREFIX = re.compile(r"(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|npm_|pypi-|SG\.|eyJ)")
_WORDS = {
    "secret": re.compile(r"token|secret|passw|api|key|bearer|credential|schlüssel|geheim|clave|mot de passe|auth", re.I),
    "phone": re.compile(r"phone|tel\b|tél|call|fax|mobile|cell|anruf|llam|appel|number|ring", re.I),
    "account": re.compile(r"account|card|iban|ssn|social|passport|tax|customer|konto|cuenta|compte|karte|tarjeta|carte", re.I),
    "harmless": re.compile(r"version|page|isbn|total|price|euro|dollar|figure|year|date|build|seite|preis|jahr|prix|año|página", re.I),
    "checksum": re.compile(r"commit|sha|md5|hash|checksum|digest|etag|revision|file|uuid|id\b", re.I),
    "order": re.compile(r"order|invoice|ticket|bestell|pedido|commande|log|time|stamp|batch", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        pieces, start = m.group().split("."), m.start()
        for k in range(0, len(pieces) - 3, 4):
            four = pieces[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not _TRACE.search(text):
        return []
    found = [(a, b, kind) for kind, find in zip(BASE, (_emails, _ips, _cards, _phones)) for a, b in find(text)]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Candidates of the further kinds, overlapping as they come; of a run of digit groups every span of neighbours."""
    out = []
    for m in _GROUPS.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for lo, end in groups[i:]:
                n += end - lo
                if n > 24:
                    break
                at = start - 1 if start > m.start() and text[start - 1] == "(" and ")" in text[start:end] else start
                if 7 <= n <= 11:
                    out.append((at, end, "local_phone"))
                if 8 <= n:
                    out.append((at, end, "account"))
    for m in _MIXED.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.append((*m.span(), "secret"))
    out += [(*m.span(), "code") for m in _CODE.finditer(text)]
    return out


def _iban(s: str) -> bool:
    """Whether the check digits of an account code fit."""
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not plain.isalnum() or not plain.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def _dated(digits: str) -> bool:
    """Digits that begin like a day of our time."""
    return len(digits) in (8, 10, 12, 14) and digits[:2] in ("19", "20") and "01" <= digits[4:6] <= "12" and "01" <= digits[6:8] <= "31"


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a whole candidate."""
    s = text[start:end]
    n = len(s)
    digits = [c for c in s if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", s)
    seps = [c for c in s if not c.isalnum()]
    before, after = text[max(0, start - 40) : start], text[end : end + 12]
    near = before[-3:].rstrip()
    left, right = _LEFT.search(before), _RIGHT.match(text, end, end + 26)
    gap, next_gap = left.group(2) if left else "", right.group(1) if right else ""
    return [
        float(_ORDER[kind]), float(n), float(len(digits)), len(digits) / n, sum(c in "abcdefABCDEF0123456789" for c in s) / n,
        sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, float(len(seps)), float(len(set(seps))), len(set(s)) / n, _entropy(s), float(luhn("".join(digits))),
        float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float("(" in s), float("." in s), float("-" in s), float("/" in s), float("=" in s), float("_" in s),
        float(bool(re.match(r"(19|20)[0-9]{2}", s))), float(near.endswith("+")), float(near[-1:] in ("'", '"') if near else 0), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(re.search(r"[$€£#]\s?$", before))),
        float(after[:1].isalnum()), float(bool(re.match(r"[.,:][0-9]", after))), float(before[-1:].isalnum() or before[-1:] in ".,/-"),
        float(len(left.group(1)) if left else 0), float(len(right.group(2)) if right else 0), float(bool(gap.strip())), float(bool(next_gap.strip())),
        float(gap != "" and gap[-1] in seps), float(next_gap != "" and next_gap[0] in seps),
        float(bool(_PREFIX.match(s))), float(kind == "code" and _iban(s)), float(_dated("".join(digits)[:14])), float(bool(re.fullmatch(r"[0-9a-f]+", s))), float(bool(re.search(r"[A-Z]{2}[0-9]{2}\x20?$", before))),
        *(float(bool(r.search(before) or r.search(after))) for r in _WORDS.values()),
    ]


#: Words and sentences of the two generators: the trees are trained on the first, their probabilities set on the second.
STYLES = (
    {
        "secret": ("token", "api_key", "secret", "password", "key"), "phone": ("call", "phone", "tel", "fax"), "account": ("account", "card", "customer", "ssn"), "iban": ("iban", "account"),
        "commit": ("commit", "sha1", "md5", "file", "revision"), "order": ("order", "invoice", "log", "batch"), "joins": (" = ", ": ", "="), "ends": (" {w}", ".", "", "### {w}"), "price": ("total", "price"), "page": ("page", "year"), "share": 0.5,
    },
    {
        "secret": ("auth token is", "clave", "Bearer", "credential:", "der schlüssel"), "phone": ("mobile", "anruf", "ring me on", "tél", "cell"), "account": ("konto", "tarjeta", "tax id", "compte", "social security"), "iban": ("IBAN:", "konto", "compte"),
        "commit": ("checksum", "etag", "hash", "digest", "uuid"), "order": ("ticket", "pedido", "stamp", "bestellung"), "joins": (" ", " -> ", ':"'), "ends": (", {w}", "!", ")", " {w} {w}"), "price": ("prix", "preis"), "page": ("seite", "año"), "share": 0.6,
    },
)


def examples(style: int = 0, seed: int = 20_240_901, each: int = 110) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): every candidate that the generators find in made-up lines."""
    rng = np.random.default_rng([seed, style])
    said_ = STYLES[style]
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    hexes, mixed, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: some("abcdefghijklmnoprstuvwz", int(rng.integers(2, 9)))
    cue = lambda name, share=0.5: pick(said_[name]) if rng.random() < share else word()
    quote = lambda s: f'"{s}"' if rng.random() < 0.5 else s
    groups = lambda s, k, sep: sep.join(s[a : a + k] for a in range(0, len(s), k))

    def key() -> str:
        return pick(
            [
                "AKIA" + some(caps + "234567", 16), "ASIA" + some(caps + "234567", 16), "AIza" + some(mixed + "_-", 35), "gh" + pick("pousr") + "_" + some(mixed, 36), "glpat-" + some(mixed, 20),
                "sk-" + some(mixed, 32), "sk_live_" + some(mixed, 24), "xox" + pick("abprs") + "-" + digit(11) + "-" + some(mixed, 24), "npm_" + some(mixed, 36), "eyJ" + some(mixed, 60),
            ]
        )

    def iban() -> str:
        country, body = some(caps, 2), pick([digit(18), some(caps, 4) + digit(14), digit(16), digit(20)])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        code = f"{country}{check:02d}{body}"
        return groups(code, 4, " ") if rng.random() < 0.6 else code

    private = {
        "secret": lambda: pick([f"{cue('secret', 1)}{pick(said_['joins'])}{quote(pick([some(hexes, 40), some(hexes, 32), some(mixed, int(rng.integers(20, 64)))]))}", f"{cue('secret')}{pick(said_['joins'])}{quote(key())}", f"{word()} {key()}"]),
        "local_phone": lambda: f"{cue('phone')} {pick(['(' + digit(3) + ') ' + digit(3) + '-' + digit(4), digit(3) + '-' + digit(3) + '-' + digit(4), digit(3) + '.' + digit(3) + '.' + digit(4), '0' + digit(2) + ' ' + digit(3) + ' ' + digit(4)])}",
        "account": lambda: f"{cue('account')} {pick([digit(16), groups(digit(16), 4, ' '), groups(digit(16), 4, '-'), digit(15), digit(3) + '-' + digit(2) + '-' + digit(4)])}",
        "code": lambda: f"{cue('iban')} {iban()}",
    }
    day = lambda: f"20{digit(1)}{rng.integers(0, 10)}{int(rng.integers(1, 13)):02d}{int(rng.integers(1, 29)):02d}"
    harmless = [
        lambda: f"{word()} 20{digit(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)} {rng.integers(10, 24)}:{rng.integers(10, 60)}",
        lambda: f"{word()} {rng.integers(1, 29)}/{rng.integers(1, 13)}/20{digit(2)} {word()}",
        lambda: f"{cue('price')} ${digit(3)}.{digit(2)} {word()} {digit(4)}.{digit(6)}",
        lambda: f"{pick(['version', 'build', word()])} {rng.integers(1, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 300)}.{digit(5)}",
        lambda: f"{pick(['isbn', word()])} 978-{digit(1)}-{digit(3)}-{digit(5)}-{digit(1)}",
        lambda: f"{cue('page')} 19{digit(2)} 20{digit(2)} 20{digit(2)}",
        lambda: f"{cue('commit')} {word()}-{word()}-{word()}{digit(2)}-{word()}",
        lambda: f"{pick(said_['commit'])} {some(hexes, pick([40, 32, 64]))}",
        lambda: f"{pick(said_['commit'])} {'-'.join(some(hexes, n) for n in (8, 4, 4, 4, 12))}",
        lambda: f"{pick(said_['order'])} {day()}{pick(['', digit(6), int(rng.integers(10, 24)) * 10000 + 3000])}",
        lambda: f"{pick(said_['order'])} #{digit(9)} {word()}",
        lambda: f"{word()} 16{digit(8)}{pick(['', digit(3)])}",
        lambda: f"{word()} {digit(3)} {digit(3)} {digit(3)} {pick(['euro', 'dollar', 'km'])}",
        lambda: f"{word()}_{word()}_{word()}_v{digit(1)} {word()}{word()}{word()}{digit(1)}",
        lambda: f"{word()}/{word()}/{word()}-{digit(3)}/{word()}{digit(2)}",
        lambda: f"{word()} {some(caps, 2)}{digit(2)} {some(caps, 4)} {some(caps, 4)} {some(caps, 4)}",
    ]
    ending = lambda: pick(said_["ends"]).format(w=word())
    out = []
    for _ in range(each):
        for kind, make in private.items():
            lead, made = word() + " " + word() + pick([" ", ", ", ".\n"]), make()
            line = lead + made + ending()
            if kind in ("account", "local_phone"):
                at = re.search(r"\(?[0-9]", made).start()
            elif kind == "code":
                at = re.search(r"[A-Z]{2}[0-9]{2}", made).start()
            else:
                at = max((m.start() for m in _MIXED.finditer(made)), default=0)
            true = (len(lead) + at, len(lead) + len(made.rstrip('"')))
            out += [(line, a, b, k, int(k == kind and (a, b) == true)) for a, b, k in proposals(line)]
        for _ in range(2):  # numbers side by side: several of a kind, mixed, or beside a small number
            kinds = [pick(["account", "local_phone"])] * 3 if rng.random() < 0.5 else [pick(["account", "local_phone"]) for _ in range(3)]
            line, true = f"{word()} {pick([cue('phone'), cue('account'), 'room'])} ", set()
            for kind in kinds[: int(rng.integers(1, 4))]:
                if rng.random() < 0.3:
                    line += digit(int(rng.integers(1, 4))) + " "
                value = private[kind]()
                value = value[re.search(r"\(?[0-9]", value).start() :]
                true.add((len(line), len(line) + len(value), kind))
                line += value + pick([" ", " ", " / ", "/", "  "])
            if rng.random() < 0.3:
                line += digit(int(rng.integers(1, 4))) + " "
            line += pick([word(), "", "."])
            out += [(line, *c, int(c in true)) for c in proposals(line)]
        for make in harmless:
            line = f"{word()} {make()}{ending()}"
            out += [(line, a, b, k, 0) for a, b, k in proposals(line)]
    return out


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a margin + b))), by Newton steps on smoothed targets."""
    yes, no = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([np.clip(margin, -MARGIN, MARGIN), np.ones(len(margin))])
    start = beta = np.array([1.0, 0.0])  # as they come, unless the lines say otherwise
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        beta = beta + np.linalg.solve(h, x.T @ (target - p) - (beta - start))
    return float(beta[0]), float(beta[1])


MARGIN = 12.0  # margins beyond it are as sure as can be


def calibrated(margin: np.ndarray, a, b) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * np.clip(margin, -MARGIN, MARGIN) + b, -30, 30)))


def threshold(p: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The smallest probability from which on the wanted share is right; equal ones stand or fall together. 2 where there is none."""
    order = np.argsort(-p, kind="stable")
    p, right = p[order], right[order]
    last = np.append(p[:-1] > p[1:], True)
    good = np.flatnonzero(last & (np.cumsum(right) >= precision * np.arange(1, len(right) + 1)))
    return float(p[good[-1]]) if len(good) else 2.0


Trained = tuple[BoostedTrees, dict[str, tuple[float, float, float]]]


@functools.lru_cache(maxsize=1)
def model() -> Trained:
    """The trees, and per kind (a, b, the smallest probability whose precision is PRECISION on lines set apart)."""
    table = lambda rows: (np.array([features(t, a, b, k) for t, a, b, k, _ in rows]), np.array([label for *_, label in rows], float))
    trees = BoostedTrees(rounds=50, depth=4).fit(*table(examples(0)))
    (fit_x, fit_y), (x, y) = table(examples(1)), table(examples(1, seed=7))
    fit_margin, margin = trees.margin(fit_x), trees.margin(x)
    made = {}
    for kind in MORE:
        a, b = platt(fit_margin[fit_x[:, 0] == _ORDER[kind]], fit_y[fit_x[:, 0] == _ORDER[kind]])
        own = x[:, 0] == _ORDER[kind]
        made[kind] = (a, b, threshold(calibrated(margin[own], a, b), y[own], PRECISION))
    return trees, made


def probabilities(trained: Trained, text: str, asked: list[tuple[int, int, str]]) -> np.ndarray:
    margin = trained[0].margin(np.array([features(text, *c) for c in asked]))
    a, b = (np.array([trained[1][k][n] for *_, k in asked]) for n in (0, 1))
    return calibrated(margin, a, b)


class _Apart:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.spans, (a, a))
        return (at == 0 or self.spans[at - 1][1] <= a) and (at == len(self.spans) or self.spans[at][0] >= b)

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


def find(text: str | None, trained: Trained | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind. A chosen candidate never covers a base span."""
    text = text or ""
    base = base_spans(text)
    taken, end = _Apart(), -1
    for a, b, _ in base:  # by start; overlapping ones become one
        if a < end:
            a = taken.spans.pop()[0]
        end = max(end, b)
        taken.add(a, end)
    asked = [c for c in proposals(text) if taken.free(c[0], c[1])] if _TRACE.search(text) else []
    if not asked:
        return base, base
    trained = trained or model()
    p = probabilities(trained, text, asked)
    chosen: list[tuple[int, int, str]] = []
    for k in np.argsort(-p, kind="stable").tolist():
        a, b, kind = asked[k]
        if p[k] >= trained[1][kind][2] and taken.free(a, b):
            chosen.append(asked[k])
            taken.add(a, b)
    return base, sorted(base + chosen, key=lambda s: (s[0], _ORDER[s[2]]))


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, trained: Trained | None = None) -> str:
    """The text with each chosen span replaced by its kind in brackets; overlaps are merged under the first kind."""
    text, out, done = text or "", [], 0
    for a, b, kind in find(text, trained)[1]:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string, n_spans long, redacted string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, counts and spans, and the redacted text if asked for.

    Null texts count as empty (no spans, the checksum of the empty list); ids of any type
    are given as they are; null ids and repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """
    trained = model()  # on the driver, and sent to the workers with the function
    names = ["id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            found = [find(t, trained) for t in texts]
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE]
            lists = [said(base) for base, _ in found]
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in lists]
            redacted = pa.array([redact(t, trained) for t in texts] if with_text else [None] * len(texts), pa.string())
            every = [pa.array([said(e) for _, e in found], pa.string()), pa.array([len(e) for _, e in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(lists, pa.string()), pa.array(sums, pa.string()), *every, redacted], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(released(run), f"id {kind}, {COLUMNS}")

"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns find e-mail addresses, IPs, card and phone numbers, leftmost and without retries. So a phone
number that a card number follows is lost to them, as are numbers without a plus sign and written-out
addresses. The field looks at clusters of digits and at written-out "at" signs. Within a cluster each
candidate segment (of at most ``MAX_SPAN`` characters, or a written-out address) has a score from features of the whole span (digit
groups, separators, check sum, neighbours); all other tokens score 0. The best segmentation comes from a
dynamic program over token ends, with the pattern's spans held fixed. Outside clusters no segment is a
candidate, so decoding cluster by cluster is exact: numbers that are written in words, or with other
separators than blanks and ``().[]/+-``, and addresses without a bracketed "at", are never candidates. Weights are fitted by gradient ascent on the conditional
likelihood (forward and backward sums over segmentations) of seeded, generated sentences.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import lean, small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_SPAN = 48
SEED = 5
EPOCHS = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Where the field looks.
_CLUSTER = re.compile(r"[+(]?[0-9][0-9 ().\[\]/+-]{5,}[0-9]")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,126}", re.I)
#: What every written-out address holds.
_AT = re.compile(r"[aA][tT] ?[\])]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_SHAPED_IP = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _number(s: str) -> int:
    s = s.lstrip("0")
    return 999 if len(s) > 3 else int(s or "0")


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            done = m.end()
            yield a, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns' spans, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_number(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


# --- the field ----------------------------------------------------------------------------------


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def features(kind: int, text: str, a: int, b: int) -> list[str]:
    """Names of the features of text[a:b] as a span of this kind."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    k = KINDS[kind]
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s))))
    near = text[max(0, a - 2) : a].rstrip() if a and text[a - 1] == " " else text[max(0, a - 1) : a]
    after = text[b : b + 2].lstrip() if text[b : b + 1] == " " else text[b : b + 1]
    return [
        k,
        f"{k} digits {sum(map(len, groups))}",
        f"{k} groups {'-'.join(str(len(g)) for g in groups[:8])}",
        f"{k} separators {seps}",
        f"{k} first {_class(s[0])}",
        f"{k} touches {_class(text[a - 1 : a])} {_class(text[b : b + 1])}",
        f"{k} before {_class(near[-1:])}",
        f"{k} after {_class(after[:1])}",
        f"{k} at {'@' in s or 'at' in s.lower()}",
    ]


def candidates(text: str, a: int, b: int, fixed: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Token ends within text[a:b], and the (start, kind, end) segments that may be spans."""
    ends = [a, *(m.end() for m in _TOKEN.finditer(text, a, b))]
    out = []
    # characters of fixed spans before each place, so that a segment is free of them if it adds none
    before = [0]
    taken = bytearray(b - a)
    for x, _, y in fixed:
        x, y = max(x, a), min(y, b)
        if x < y:
            taken[x - a : y - a] = b"\1" * (y - x)
    before += itertools.accumulate(taken)
    for i, x in enumerate(ends[:-1]):
        if text[x].isspace():
            continue
        mail = _WRITTEN.match(text, x, b)
        reach = max(MAX_SPAN, mail.end() - x if mail else 0)
        for j in range(i + 1, len(ends)):
            y = ends[j]
            if y - x > reach:
                break
            last = text[y - 1]
            if last.isspace() or before[y - a] > before[x - a]:
                continue
            s = text[x:y]
            digits = re.sub(r"[^0-9]", "", s)
            n = len(digits)
            if last.isdigit() and n >= 4 and y - x <= MAX_SPAN:
                if 12 <= n <= 19 and s[0].isdigit() and not re.search(r"[^0-9 -]|[ -]{2}", s) and luhn(digits):
                    out.append((x, 2, y))
                if 9 <= n <= 15 and s[0] in "+(0123456789" and not re.search(r"[^0-9 ().+-]|[ ]{2}", s) and "+" not in s[1:]:
                    out.append((x, 3, y))
                if n <= 12 and _SHAPED_IP.fullmatch(s) and all(_number(p) <= 255 for p in re.findall(r"[0-9]+", s)):
                    out.append((x, 1, y))
            if mail and _WRITTEN.fullmatch(s):
                out.append((x, 0, y))
    return ends, out


def decode(ends: list[int], segments: list[tuple[int, int, int]], scores: list[float]) -> list[tuple[int, int, int]]:
    """The segmentation with the greatest score; ties go to fewer spans, then to earlier ones."""
    by_end: dict[int, list] = {}
    for seg, s in zip(segments, scores):
        by_end.setdefault(seg[2], []).append((seg, s))
    best: dict[int, tuple] = {ends[0]: (0.0, None, None)}
    for before, e in zip(ends, ends[1:]):
        top = (best[before][0], before, None)
        for seg, s in by_end.get(e, ()):
            if best[seg[0]][0] + s > top[0]:
                top = (best[seg[0]][0] + s, seg[0], seg)
        best[e] = top
    out, at = [], ends[-1]
    while at is not None and best[at][1] is not None:
        if best[at][2]:
            out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def _marginals(ends: list[int], segments: list, scores: list[float]) -> list[float]:
    """The probability of each segment, by forward and backward sums."""
    place = {e: i for i, e in enumerate(ends)}
    n = len(ends)
    into, outof = [[] for _ in ends], [[] for _ in ends]
    for k, (a, _, b) in enumerate(segments):
        into[place[b]].append((place[a], scores[k]))
        outof[place[a]].append((place[b], scores[k]))

    def add(xs):
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs))

    f, g = [0.0] * n, [0.0] * n
    for i in range(1, n):
        f[i] = add([f[i - 1], *(f[j] + s for j, s in into[i])])
    for i in range(n - 2, -1, -1):
        g[i] = add([g[i + 1], *(g[j] + s for j, s in outof[i])])
    return [math.exp(f[place[a]] + scores[k] + g[place[b]] - f[-1]) for k, (a, _, b) in enumerate(segments)]


def _sentences(seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their spans: (text, [(start, kind, end)])."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        s = r.choice("3456") + d(r.choice((14, 14, 14, 13)))
        s += next(c for c in "0123456789" if luhn(s + c))
        return (2, s if r.random() < 0.6 or len(s) != 16 else r.choice((" ", "-")).join(s[i : i + 4] for i in range(0, 16, 4)))

    def phone():
        return (3, r.choice((f"+{r.choice(('1', '44', '49', '33'))} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}")))

    def address():
        sep = r.choice(("[.]", "(.)", " . "))
        return (1, sep.join(str(r.randrange(256)) for _ in range(4)))

    def mail():
        at, dot = r.choice((("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")))
        return (0, f"{r.choice(('ann', 'bo.lee', 'x1', 'kim'))}{at}{r.choice(('mail', 'post'))}{d(1)}{dot}example{dot}com")

    def other():
        return (None, r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"19{d(2)}-20{d(2)}", f"{d(2)} {d(3)} {d(3)}", d(16)[:-1] + "x", f"{d(1)}.{d(1)}.{d(2)}", d(7), f"{d(3)}-{d(4)}", f"no {d(12)}", f"{d(4)}/{d(2)}/{d(2)} {d(2)}", f"{d(5)} {d(5)}", f"{d(9)}", f"{d(2)}.{d(2)}.{d(4)} {d(2)}", f"ab{d(10)}f", f"{d(10)}", f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)}")))

    out = []
    for _ in range(420):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            kind, s = r.choice((card, card, phone, phone, address, mail, other, other, other))()
            text += r.choice(("", "the ", "call ", "of et la ", "(")) if not text.endswith(" ") or r.random() < 0.5 else ""
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(s)))
            text += s + r.choice((" ", " ", ", ", ". "))
        out.append((text, spans))
    return out


def clusters(text: str) -> list[tuple[int, int]]:
    """Parts of a text that may hold spans, apart from each other."""
    found = [m.span() for m in _CLUSTER.finditer(text)]
    if _AT.search(text):
        found += [m.span() for m in _WRITTEN.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.lru_cache(maxsize=2)
def fit(seed: int = SEED, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log likelihood, with shrinkage."""
    data = []
    for text, spans in _sentences(seed):
        for a, b in clusters(text):
            ends, segs = candidates(text, a, b, [])
            if segs:
                gold = set(spans)
                data.append((ends, segs, [features(k, text, x, y) for x, k, y in segs], [float(s in gold) for s in segs]))
    w: dict[str, float] = {}
    square: dict[str, float] = {}
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for ends, segs, feats, gold in data:
            p = _marginals(ends, segs, [sum(w.get(f, 0.0) for f in fs) for fs in feats])
            grad: dict[str, float] = {}
            for fs, y, q in zip(feats, gold, p):
                if abs(y - q) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + y - q
            for f, g in grad.items():
                g -= 0.002 * w.get(f, 0.0)
                square[f] = square.get(f, 0.0) + g * g
                w[f] = w.get(f, 0.0) + 0.4 * g / math.sqrt(square[f] + 1e-6)
    return w


def all_spans(text: str, weights: dict[str, float], base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """The patterns' spans and those that the field adds, sorted."""
    base = base_spans(text) if base is None else base
    out = list(base)
    reach = list(itertools.accumulate((e for _, _, e in base), max))  # ascending, as starts are
    for a, b in clusters(text):
        ends, segs = candidates(text, a, b, base[bisect.bisect_right(reach, a) : bisect.bisect_left(base, (b,))])
        if segs:
            out += decode(ends, segs, [sum(weights.get(f, 0.0) for f in features(k, text, x, y)) for x, k, y in segs])
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_TRIGGER = re.compile(r"[0-9@]|[aA][tT] ?[\])]")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of each document, with the
    columns ``keep`` and, if asked for, ``redacted``.

    Counts and digest are those of the fixed patterns; ``spans`` lists all, by start, then kind; places
    are code points. Null and empty texts have none, very long ones are looked at whole; a null text stays null when redacted. Rows that repeat
    an id, or have none, are returned each. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(fit())
    nothing = ([], [])
    kept = [(f"keep{i}", c) for i, c in enumerate((id_col, *keep))]
    names = [*(k for k, _ in kept), *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *(["redacted"] if with_text else [])]

    def run(batches):
        w = weights.value
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            got = []
            for t in texts:
                if t and _TRIGGER.search(t):
                    base = base_spans(t)
                    got.append((base, all_spans(t, w, base)))
                else:
                    got.append(nothing)
            out = [*b.columns[: len(kept)], *(pa.array([sum(s[1] == i for s in base) for base, _ in got], pa.int64()) for i in range(len(KINDS)))]
            out.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() if base else empty for base, _ in got]))
            out += [pa.array([joined(s) for _, s in got]), pa.array([len(s) - len(base) for base, s in got], pa.int64())]
            if with_text:
                out.append(pa.array([redact(t, s) if s else t for t, (_, s) in zip(texts, got)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(*(F.col(c).alias(k) for k, c in kept), F.col(text_col).alias("text"))
    schema = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in kept] + [f"{n} {'string' if n in ('base_sha256', 'spans', 'redacted') else 'bigint'}" for n in names[len(kept) :]]
    out = rows.mapInArrow(lean(run), ", ".join(schema))
    return out.withColumnsRenamed(dict(kept))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """``find_pii`` over all documents; rows as its docstring says."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Personal data by a semi-Markov conditional random field over whole spans.

Candidate segments of a text are groups of digits with what may stand between them, and addresses with
an at-sign in any spelling, none longer than a fixed number of groups. Each candidate is scored as a whole
for each kind: its digits and how they are grouped, separators, Luhn sum, the parts' size, what stands on
both sides, a cue word before it, and whether a fixed pattern matches just this span. A dynamic programme
over the boundaries of the candidates chooses segments and kinds jointly: the best path of the text.

The weights are learned by conditional likelihood (forward and backward sums over the same lattice) from a
bounded sample of the corpus as the fixed patterns label it, and from variants of those and of generated
values that the patterns miss: other separators, no country code, spelled at-signs, and near misses that
are no personal data. What the patterns find always stays; the model adds what it finds elsewhere.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import map_batches, texts_of, with_fields

# The kinds in their order, and the patterns of the base rules.
KINDS = ("email", "ip", "card", "phone")
_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# What the candidates are made of. An island holds every match of the three numeric patterns that starts in it.
_ISLAND = re.compile(r"[0-9+][0-9+\x20()./\[\]-]*")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\x20()./\[\]-]{1,4}")
_AT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.ASCII | re.IGNORECASE)
_SPELLED = re.compile(r"[\x20(\[{](?:dot|\.)[\x20)\]}]|@\x20|\x20@|[(\[{]\x20?(?:at|@)", re.ASCII | re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
MOST_GROUPS, MOST_DIGITS = 12, 19
# Words before a value that tell its kind.
CUES = {"phone": ("tel", "phone", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "sms", "telefon", "teléfono", "téléphone"), "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte"), "ip": ("ip", "host", "server", "address", "addr", "gateway", "dns"), "email": ("email", "mail", "contact", "write", "reach", "correo", "courriel")}
_CUE = {w: k for k, words in CUES.items() for w in words}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(part: str) -> str:
    return "".join(_GROUP.findall(part))


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _RIGHT.match(text, at + 1) if start < at else None
        if found is not None:
            end = found.end()
            out.append((start, end))
        # Whatever starts behind this sign has its own.
        end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str, islands: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind; code points, end exclusive."""
    out = [("email", s, e) for s, e in _emails(text)]
    for begin, stop in islands if islands is not None else islands_of(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text, begin, stop) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text, begin, stop):
            if len(m[0]) >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text, begin, stop) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def islands_of(text: str) -> list[tuple[int, int]]:
    """Runs that may hold a number of four digits or more, in any grouping."""
    return [m.span() for m in _ISLAND.finditer(text) if m.end() - m.start() >= 4]


def candidates(text: str, islands: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every segment that the model scores."""
    out = []
    if "@" in text or _SPELLED.search(text):
        out += [("email", m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    for begin, stop in islands:
        groups = [m.span() for m in _GROUP.finditer(text, begin, stop)]
        for i, (s, _) in enumerate(groups):
            start = s - 1 if s > 0 and text[s - 1] in "+(" else s
            start = start - 1 if start < s and text[start] == "(" and start > 0 and text[start - 1] == "+" else start
            n = 0
            for j in range(i, min(len(groups), i + MOST_GROUPS)):
                if j > i and _BETWEEN.fullmatch(text, groups[j - 1][1], groups[j][0]) is None:
                    break
                n += groups[j][1] - groups[j][0]
                if n > MOST_DIGITS:
                    break
                end = groups[j][1]
                if j - i == 3 and n <= 12:
                    out.append(("ip", s, end))
                if n >= 13:
                    out.append(("card", s, end))
                if 7 <= n <= 15:
                    out.append(("phone", start, end))
    return out


def _side(c: str) -> str:
    return "none" if not c else "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "@=:\"'#$%_" else "mark"


def features(text: str, kind: str, start: int, end: int, rules: frozenset) -> list[str]:
    """The features of a segment as a kind; rules are the spans of the fixed patterns."""
    part = text[start:end]
    before = _WORD.findall(text, max(0, start - 24), start)
    cue = _CUE.get(before[-1].lower()) if before else None
    out = ["bias", f"before {_side(text[start - 1 : start])}", f"after {_side(text[end : end + 1])}", f"cue {cue}"]
    if (kind, start, end) in rules:
        out.append("pattern")
    elif any(s < end and start < e for _, s, e in rules):
        out.append("crosses")
    if kind == "email":
        local = re.split("[@(\\[{ ]", part, maxsplit=1)[0]
        last = re.split(r"[^A-Za-z0-9-]", part)[-1]
        out += ["sign " + ("@" if "@" in part else "word"), "blanks" if " " in part else "tight", "bracket" if re.search(r"[\[({]", part) else "open", f"end {'word' if last.isalpha() and 2 <= len(last) <= 6 else 'other'}", "local mixed" if re.search("[0-9._%+-]", local) else "local plain", "dot word" if re.search(r"dot", part, re.IGNORECASE) else "dot mark"]
    else:
        groups = _GROUP.findall(part)
        n = sum(map(len, groups))
        marks = "".join(sorted(set(re.sub("[0-9]", "", part)))) or "none"
        out += [f"digits {n}", f"groups {len(groups)}", f"marks {marks}", f"shape {'-'.join(str(len(g)) for g in groups)}", f"first {part[0] if not part[0].isdigit() else 'zero' if part[0] == '0' else 'digit'}", f"cue {cue} {'one' if len(groups) == 1 else 'more'}"]
        if n == 13 and part.startswith(("978", "979")):
            out.append("book number")
        if kind == "card":
            out.append(f"sum {luhn(''.join(groups))}")
        if kind == "ip":
            out.append(f"parts {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return [f"{kind}: {x}" for x in out]


class Lattice:
    """Boundaries of the candidates, and the candidates that start at each."""

    def __init__(self, text: str, islands: list[tuple[int, int]], rules: list[tuple[str, int, int]]) -> None:
        known = frozenset(rules)
        self.segments = sorted(set(candidates(text, islands)), key=lambda x: (x[1], x[2], KINDS.index(x[0])))
        self.points = sorted({p for _, s, e in self.segments for p in (s, e)})
        at = {p: i for i, p in enumerate(self.points)}
        self.names = [features(text, *x, known) for x in self.segments]
        self.arcs: list[list[tuple[int, int, int]]] = [[] for _ in self.points]  # (segment, its last point, its kind)
        for i, (kind, s, e) in enumerate(self.segments):
            self.arcs[at[s]].append((i, at[e], KINDS.index(kind) + 1))

    def gap(self, p: int) -> bool:
        """Whether the kind before is still known behind the piece from point p to the next."""
        return self.points[p + 1] - self.points[p] <= 2


class Model:
    """Weights of features, and of a kind next to another (0 is none)."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def best(self, lattice: Lattice) -> list[tuple[str, int, int, float]]:
        """The segments of the best path, each with its score."""
        n, kinds = len(lattice.points), len(KINDS) + 1
        if not n:
            return []
        score = [self.score(x) for x in lattice.names]
        value = [[-math.inf] * kinds for _ in range(n)]
        back: list[list[tuple[int, int, int] | None]] = [[None] * kinds for _ in range(n)]
        value[0][0] = 0.0
        for p in range(n):
            for y, v in enumerate(value[p]):
                if v == -math.inf:
                    continue
                if p + 1 < n and v > value[p + 1][z := y if lattice.gap(p) else 0]:
                    value[p + 1][z], back[p + 1][z] = v, (p, y, -1)
                for i, q, kind in lattice.arcs[p]:
                    if (w := v + score[i] + self.steps[y, kind]) > value[q][kind]:
                        value[q][kind], back[q][kind] = w, (p, y, i)
        out, p, y = [], n - 1, max(range(kinds), key=lambda k: value[n - 1][k])
        while (step := back[p][y]) is not None:
            p, y, i = step
            if i >= 0:
                out.append((*lattice.segments[i], score[i]))
        return out[::-1]


def _expected(model: Model, lattice: Lattice, score: list[float]) -> tuple[list[float], np.ndarray]:
    """The chance of every segment, and of every step between kinds, over all paths."""
    n, kinds = len(lattice.points), len(KINDS) + 1
    ahead = np.full((n, kinds), -np.inf)
    ahead[0, 0] = 0.0
    for p in range(n):
        if p + 1 < n:
            if lattice.gap(p):
                ahead[p + 1] = np.logaddexp(ahead[p + 1], ahead[p])
            else:
                ahead[p + 1, 0] = np.logaddexp(ahead[p + 1, 0], np.logaddexp.reduce(ahead[p]))
        for i, q, kind in lattice.arcs[p]:
            ahead[q, kind] = np.logaddexp(ahead[q, kind], np.logaddexp.reduce(ahead[p] + model.steps[:, kind]) + score[i])
    behind = np.full((n, kinds), -np.inf)
    behind[n - 1] = 0.0
    for p in range(n - 2, -1, -1):
        behind[p] = behind[p + 1] if lattice.gap(p) else behind[p + 1, 0]
        for i, q, kind in lattice.arcs[p]:
            behind[p] = np.logaddexp(behind[p], model.steps[:, kind] + score[i] + behind[q, kind])
    total = np.logaddexp.reduce(ahead[n - 1])
    chance, steps = [0.0] * len(score), np.zeros((kinds, kinds))
    for p in range(n):
        for i, q, kind in lattice.arcs[p]:
            part = np.exp(ahead[p] + model.steps[:, kind] + score[i] + behind[q, kind] - total)
            chance[i] = float(part.sum())
            steps[:, kind] += part
    return chance, steps


def _gold(lattice: Lattice, labels: list[tuple[str, int, int]]) -> tuple[list[int], np.ndarray]:
    """The labelled segments, none of which overlap, and their steps."""
    at, kept, steps, before = 0, [], np.zeros((len(KINDS) + 1,) * 2), (-9, 0)
    number = {x: i for i, x in enumerate(lattice.segments)}
    for label in sorted(labels, key=lambda x: (x[1], -x[2])):
        if label in number and label[1] >= at:
            kept.append(number[label])
            kind = KINDS.index(label[0]) + 1
            steps[before[1] if label[1] - before[0] <= 2 else 0, kind] += 1
            at, before = label[2], (label[2], kind)
    return kept, steps


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], *, rounds: int = 5, rate: float = 0.5, shrink: float = 1e-3) -> Model:
    """Weights from texts with labelled spans, by steps along the gradient of the log likelihood of each text."""
    made = []
    for text, labels in rows:
        islands = islands_of(text)
        lattice = Lattice(text, islands, base_spans(text, islands))
        if lattice.points:
            made.append((lattice, *_gold(lattice, labels)))
    model = Model({}, np.zeros((len(KINDS) + 1,) * 2))
    size: dict[str, float] = {}
    step_size = np.full_like(model.steps, 1e-6)
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(made)
        for lattice, gold, gold_steps in made:
            chance, steps = _expected(model, lattice, [model.score(x) for x in lattice.names])
            change: dict[str, float] = {}
            for i, c in enumerate(chance):
                d = (1.0 if i in gold else 0.0) - c
                if abs(d) > 1e-4:
                    for name in lattice.names[i]:
                        change[name] = change.get(name, 0.0) + d
            for name, d in change.items():
                d -= shrink * model.weights.get(name, 0.0)
                size[name] = size.get(name, 1e-6) + d * d
                model.weights[name] = model.weights.get(name, 0.0) + rate * d / math.sqrt(size[name])
            d = gold_steps - steps - shrink * model.steps
            step_size += d * d
            model.steps += rate * d / np.sqrt(step_size)
    return model


def _card(r: random.Random, n: int = 16) -> str:
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _variants(kind: str, value: str, r: random.Random) -> list[tuple[str, str | None]]:
    """Other ways to write a value, with its kind, and near misses, with none."""
    d = _digits(value)
    fours = lambda x, mark: mark.join(x[i : i + 4] for i in range(0, len(x), 4))
    if kind == "phone":
        d = d[-10:]
        a, b, c = d[:3], d[3:6], d[6:]
        plain = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00 1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"]
        return [(r.choice(plain), kind), (r.choice(plain), kind), (f"{r.choice(CUES['phone'])} {r.choice([d, '0' + d, f'{a} {b} {c}', f'{a}/{b}{c}'])}", kind), (d, None), (f"20{d[:2]}-0{d[2]}-1{d[3]} {d[4:6]}.{d[6:8]}", None), (f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:8]}", None), (d + d[:3], None)]
    if kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + r.randrange(1, 9)) % 10)
        return [(fours(d, r.choice([".", "/", "  "])), kind), (f"{r.choice(CUES['card'])} {fours(d, r.choice(['.', ' - ']))}", kind), (wrong, None), (fours(wrong, r.choice([" ", "-", "."])), None), (d + str(r.randrange(10)), None)]
    if kind == "ip":
        p = [str(r.randrange(256)) for _ in range(4)]
        return [("[.]".join(p), kind), ("(.)".join(p), kind), (".".join([str(r.randrange(256, 999)), *p[1:]]), None), (".".join(p[:3]), None), (" ".join(p), None), ("-".join(p), None), ("/".join(p), None)]
    local, domain = value.split("@", 1)
    spelled = domain.replace(".", r.choice([" dot ", "[dot]", "(dot)", " [dot] "]))
    return [(f"{local} at {spelled}", kind), (f"{local}{r.choice(['[at]', '(at)', ' [at] ', ' (at) '])}{r.choice([domain, spelled])}", kind), (f"{local} @ {domain}", kind), (f"{local.split('.')[0]} at {domain.split('.')[0]}", None), (f"meet at {domain}", None), (f"look at {local.split('.')[0]}.", None)]


# Numbers that are no personal data: book and order numbers, dates, times, sums, measures.
_ORDINARY: tuple[Callable[[random.Random], str], ...] = (
    lambda r: f"97{r.choice('89')}-{r.randrange(10)}-{r.randrange(100, 999)}-{r.randrange(10000, 99999)}-{r.randrange(10)}",
    lambda r: f"97{r.choice('89')}{r.randrange(10**9, 10**10)}",
    lambda r: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02} {r.randrange(24):02}:{r.randrange(60):02}",
    lambda r: f"{r.randrange(1, 29):02}.{r.randrange(1, 13):02}.{r.randrange(1900, 2100)} {r.randrange(1, 29):02}.{r.randrange(1, 13):02}.{r.randrange(1900, 2100)}",
    lambda r: f"{r.randrange(1, 999)} {r.randrange(1000):03} {r.randrange(1000):03}",
    lambda r: f"{r.randrange(10)}.{r.randrange(10**6, 10**14)}",
    lambda r: f"{r.randrange(1900, 2100)}-{r.randrange(1900, 2100)}",
    lambda r: f"no. {r.randrange(10**7, 10**12)}/{r.randrange(100)}",
)


def training_rows(windows: list[str], seed: int = 7, generated: int = 60) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of the corpus as the patterns label them, and variants of the values in them and of generated ones."""
    r = random.Random(seed)
    rows = [(w, base_spans(w)) for w in windows]
    values = [(k, w[s:e]) for w, spans in rows for k, s, e in spans]
    word = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    for _ in range(generated):
        values += [("phone", f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"), ("card", _card(r)), ("ip", "1.2.3.4"), ("email", f"{word(r.randrange(3, 9))}{r.choice(['', '.' + word(4), '_7', str(r.randrange(99))])}@{word(6)}.{r.choice(['com', 'org', 'example.com', 'de'])}")]
    plain = [x for w in windows for x in _WORD.findall(w)][:5000] or ["the", "of", "and"]
    around = lambda: " ".join(r.choice(plain) for _ in range(r.randrange(1, 4)))
    r.shuffle(values)
    for kind, value in values[: 8 * generated]:
        for text, label in r.sample(options := _variants(kind, value, r), min(3, len(options))):
            lead = f"{around()}{r.choice([' ', ', ', ': '])}" if r.random() < 0.85 else ""
            cue = _WORD.match(text)
            skip = cue.end() + 1 if kind in ("phone", "card") and cue else 0
            whole = f"{lead}{text}{r.choice([' ', '. ', ', ', ''])}{around() if r.random() < 0.8 else ''}"
            rows.append((whole, [(label, len(lead) + skip, len(lead) + len(text))] if label else []))
        # Two values side by side, which the patterns may take for one, and one that is repeated.
        lead, (other, more) = around(), r.choice(values)
        rows.append((f"{lead} {value} {more}", [(kind, len(lead) + 1, len(lead) + 1 + len(value)), (other, len(lead) + 2 + len(value), len(lead) + 2 + len(value) + len(more))]))
        both = f"{lead} {value} {value}"
        rows.append((both, base_spans(both)))
        rows.append((f"{lead} {r.choice(_ORDINARY)(r)} {lead}", []))
    return rows


def _windows(docs: DataFrame, most: int, per_text: int = 4, side: int = 40) -> list[str]:
    """Parts of texts around what may be personal data: of 50 * `most` documents at most, by a hash of doc_id; `most` parts in all."""
    n = max(1, docs.count())
    share = F.abs(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))) % 1_000_000) < math.ceil(1_000_000 * min(1.0, 25 * most / n))

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in texts_of(batch):
            places = [x for x in islands_of(text) if len(_digits(text[slice(*x)])) >= 5][:per_text] + [(m.start(), m.end()) for m, _ in zip(re.finditer("@", text), range(per_text), strict=False)]
            found += [text[max(0, s - side) : min(e, s + 80) + side] for s, e in places]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["window"])

    sample = map_batches(docs.select("doc_id", "text").where("text is not null").where(share).select("text"), cut_out, "window string").distinct()
    return sorted(x.window for x in sample.orderBy(F.xxhash64("window"), "window").limit(most).collect())


def scan(text: str, model: Model | None, least: float = 1.0) -> list[tuple[str, int, int, bool, float | None]]:
    """(kind, start, end, base, score) by start, then kind: the patterns' spans, and the model's that touch none of them."""
    islands = islands_of(text)
    if not islands and "@" not in text and not _SPELLED.search(text):
        return []
    rules = base_spans(text, islands)
    lattice = Lattice(text, islands, rules) if model is not None else None
    scores = {x[:3]: x[3] for x in model.best(lattice)} if lattice is not None and lattice.segments else {}
    out = [(k, s, e, True, scores.get((k, s, e))) for k, s, e in rules]
    taken, i = sorted((s, e) for _, s, e in rules), 0
    reach = -1
    for (k, s, e), score in sorted(scores.items(), key=lambda x: x[0][1]):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s and score >= least:
            out.append((k, s, e, False, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_FIELD = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def learn(docs: DataFrame, *, max_train: int = 400) -> Model:
    """A model from docs(doc_id, text): at most max_train parts of texts (of 50 times as many documents), and variants."""
    return fit(training_rows(_windows(docs, max_train)))


def find_pii(docs: DataFrame, *, model: Model | None = None, max_train: int = 400) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns plus pii array<struct<kind, start, end, base, score>>.

    Kinds: email, ip, card, phone. base spans are those of the fixed patterns and always stay; the others are
    the model's (learned from docs where none is given) and touch no base span; score is the model's, null
    where its best path has not that span. Whole texts are scanned, in one pass, each row alone; null and
    empty texts have an empty array. A table without rows gives none. An input column named pii is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != "pii"])
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, max_train=max_train))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": s, "end": e, "base": b, "score": c} for k, s, e, b, c in scan(t, shared.value)] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, type=_SPAN)], names=[*batch.schema.names, "pii"])

    return map_batches(docs, run, with_fields(docs, f"pii {_FIELD}"))


def redact_pii(docs: DataFrame, *, model: Model | None = None, mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]", max_train: int = 400) -> DataFrame:
    """docs with every span of text replaced by the mark of its kind; spans that overlap become one. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, max_train=max_train))
    where = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end, *_ in scan(text, shared.value) if text else ():
            if start >= at:
                out += [text[at:start], mark(kind)]
            at = max(at, end)
        return "".join([*out, text[at:]]) if at else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(where, "text", pa.array([clean(t) for t in batch.column(where).to_pylist()], type=pa.string()))

    return map_batches(docs, run, docs.schema)

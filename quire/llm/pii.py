"""Personal data: generators propose overlapping spans, a forest judges them, calibrated thresholds select.

Base spans (email, ip, card, phone by the patterns below, leftmost and without overlap for each kind) are always kept.
Beside them generators propose far more spans than are right, also overlapping ones: written-out addresses (``name (at) host (dot)
org``), IPv6, windows of up to ``MAX_GROUPS`` digit groups as cards, phones or social security numbers, and IBANs.  A forest of
trees judges each by format (lengths, groups, check sums) and context (neighbouring characters, cue words before it, digits that
go on outside it).  Each kind has its own threshold, the lowest that held-out documents confirm.  Of added spans that
overlap the more probable one stays; none overlaps a base span.  API keys and passwords are not personal data and are left alone.

There are no labels of personal data, so the trees learn from the documents, into each of which made-up personal data and a
look-alike (dates, versions, prices, order numbers, ISBNs, failing cards) are put at word borders; candidates that are in the
documents themselves are positive if they are base spans and negative otherwise.  Every whole text takes part: three of four
by a hash in the trees, the others in the thresholds.  Made-up sentences (``FILLER``) with more of both are added, so that small
tables have examples of all kinds.  Finding reads every whole text and nothing else of a row.

Cases: null and empty texts have no spans; repeated rows get equal results; a null doc_id is like any other;
without documents the trees learn from made-up sentences.  Numbers of any length are read; a window
has 7 to 19 digits, as the formats do.  Empty table: no rows.  Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import ipaddress
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, forest
from .store import slices, trim, with_fields, written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Texts that are added to the documents when trees are fitted, and how often.
FILLER = ("The quick writer sent a short note about the meeting and then went home. " * 6, "Der Bericht wurde gestern von der Leitung gelesen und besprochen, danach kam nichts mehr. " * 6)
FILLER_ROWS = 400
#: Held-out precision that a threshold must reach.
MIN_PRECISION = 0.99
MAX_GROUPS = 7

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does: inside a run the same parts follow.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    """Email, ip, card and phone spans by the fixed patterns, by start and kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:  # from the sign outwards, so long runs without one cost nothing
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    # addresses and cards lie within chains of digits, and phone numbers begin with a plus
    chains = [c.span() for c in _CHAIN.finditer(text) if c.end() - c.start() >= 7]
    out += [("ip", m.start(), m.end()) for c in chains for m in _IP.finditer(text, *c) if all(map(_small, m.group().split(".")))]
    for kind, pattern, least, most, within in (("card", _CARD, 14, 19, chains), ("phone", _PHONE, 10, 15, [(text.find("+"), len(text))] if "+" in text else [])):
        for m in (m for c in within for m in pattern.finditer(text, *c)):
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=_place)


def _place(span: tuple) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# Every alternative begins with a sign, so the search jumps to it.
_AT = re.compile(r"[(\[{<][ ]?[Aa][Tt][ ]?[)\]}>][ ]?|[ ](?:[(\[{<][ ]?[Aa][Tt][ ]?[)\]}>][ ]?|[Aa][Tt][ ])|@")
_DOT = r"(?:[ ]?[(\[{<][ ]?dot[ ]?[)\]}>][ ]?|[ ]dot[ ]|\.)"
_FAR = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{0,4}}", re.I)
_NEAR = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/]{1,3}+[0-9]++)*+")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_GROUP = re.compile(r"[0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap, and most are wrong."""
    out: set[Span] = set()
    for m in _AT.finditer(text):
        near = _NEAR.search(text[max(0, m.start() - 64) : m.start()])
        far = _FAR.match(text, m.end())
        if near and far and (m.group().lower() != " at " or " dot " in far.group().lower()):
            out.add(("email", m.start() - len(near.group()), far.end()))
    for m in _IP6.finditer(text) if _COLONS.search(text) else ():
        out.add(("ip", m.start(), m.end()))
    for m in _IBAN.finditer(text):
        out.add(("iban", m.start(), m.end()))
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        for m in _IP.finditer(text, chain.start(), chain.end()):
            out.add(("ip", m.start(), m.end()))
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, chain.start(), chain.end())]
        for i, (begin, _) in enumerate(groups):
            lead = begin - 1 if begin and text[begin - 1] in "+(" else begin
            n = 0
            for a, b in groups[i : i + MAX_GROUPS]:
                n += b - a
                if n > 19:
                    break
                if n >= 13:
                    out.add(("card", begin, b))
                if 7 <= n <= 15:
                    out.add(("phone", lead, b))
                if n == 9:
                    out.add(("ssn", begin, b))
    return sorted(out, key=_place)


#: Words before a span that speak for a kind, or against all (the last list).
CUES = (
    ("mail", "e-mail", "correo", "courriel", "contact", "kontakt", "write to", "schreib"),
    ("ip", "server", "host", "client", "adresse", "address", "ping", "login from"),
    ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    ("phone", "tel", "call", "mobil", "cell", "fax", "ruf", "llama", "appel", "whatsapp"),
    ("iban", "bank", "account", "konto", "cuenta", "compte"),
    ("ssn", "social security", "tax id", "sozial", "seguro social", "passport"),
    ("version", "v.", "order", "invoice", "isbn", "date", "page", "ref", "ticket", "id:", "no.", "nr", "total", "price", "section", "build", "part", "serial"),
)
_CUES = [re.compile("|".join(rf"\b{re.escape(w)}" for w in words), re.I) for words in CUES]


def _mod97(text: str) -> bool:
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _is_ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def _outside(text: str, at: int, step: int) -> tuple[int, int, int]:
    """(kind of the character beside a span, kind of the one beyond it, whether digits go on behind separators)."""
    seen = []
    for k in range(4):
        c = text[at + k * step] if 0 <= at + k * step < len(text) else "\n"
        seen.append(0 if c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ",;!?)(\"'[]<>" else 4 if c in ".:" else 5 if c in "-/_#=" else 6)
    more = next((k for k, s in enumerate(seen) if s == 1 and all(x in (0, 4, 5) for x in seen[:k])), -1)
    return seen[0], seen[1], int(more >= 0)


def features(text: str, spans: list[Span]) -> np.ndarray:
    """One row for each span: its format and its context."""
    rows = []
    for kind, begin, end in spans:
        s = text[begin:end]
        groups = _GROUP.findall(s)
        digits, sizes = "".join(groups), [len(g) for g in groups] or [0]
        before, low = text[max(0, begin - 28) : begin], s.lower()
        tail = re.split(r"\.| dot |[)\]}>]\s?", low)[-1] if kind == "email" else ""
        rows.append(
            [
                *(kind == k for k in KINDS), len(s), len(digits), sum(map(str.isalpha, s)), sum(map(str.isupper, s)), s.count(" "), s.count("."), s.count("-"), s.count("/"), s.count("("), s.count(")"), s.count(":"),
                len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), sizes[1] if len(sizes) > 1 else 0, s[:1] == "+", s[:1] == "(", digits[:1] == "0", digits[:2] == "00", int(digits[:1] or -1), len(set(digits)),
                len(digits) >= 13 and luhn(digits), kind == "iban" and _mod97(s), kind == "ip" and _is_ip(s), kind == "ip" and len(groups) == 4 and all(map(_small, groups)), "@" in s, " at " in low, "dot" in low, len(tail) if tail.isalpha() else 0,
                *_outside(text, begin - 1, -1), *_outside(text, end, 1), len(set(re.sub("[0-9A-Za-z]", "", s))), *(bool(c.search(before)) for c in _CUES),
            ]
        )
    return np.array(rows, dtype=np.float32) if rows else np.zeros((0, 0), dtype=np.float32)


def _check_digit(body: str) -> str:
    return next(body + c for c in "0123456789" if luhn(body + c))


class _Maker:
    """Made-up personal data and look-alikes, from a fixed seed."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        return "".join(self.rng.choice("bdfgklmnprstvz") + self.rng.choice("aeiou") for _ in range(self.rng.randint(2, 4)))

    def email(self) -> str:
        r = self.rng
        user, host, top = self.name() + r.choice(["", ".", "_"]) + r.choice([self.name(), self.digits(2), ""]), self.name() + r.choice(["", "-mail", self.digits(1)]), r.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
        user = user.strip("._") or "me"
        form = r.choice(["{0}@{1}.{2}"] * 3 + ["{0} (at) {1} (dot) {2}", "{0}(at){1}.{2}", "{0} [at] {1} [dot] {2}", "{0} at {1} dot {2}", "{0}[at]{1}.{2}", "{0} {{at}} {1} {{dot}} {2}", "{0} <at> {1}.{2}"])
        return form.format(user, host, top.split(".")[0] if "dot" in form else top)

    def ip(self) -> str:
        r = self.rng
        if r.random() < 0.5:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        whole = ipaddress.IPv6Address(r.getrandbits(128) & ~(r.choice([0, 0xFFFFFFFF, 0xFFFFFFFFFFFF]) << 32))
        return r.choice([whole.compressed, whole.exploded])

    def card(self) -> str:
        r = self.rng
        n = r.choice([13, 14, 15, 16, 16, 16, 19])
        d = _check_digit(r.choice("3456") + self.digits(n - 2))
        cut = [4, 6, 5] if n == 15 else [4] * ((n + 3) // 4)
        at = np.cumsum([0, *cut])
        return r.choice([" ", "-", "."]).join(d[a:b] for a, b in zip(at[:-1], at[1:])) if r.random() < 0.6 else d

    def phone(self) -> tuple[str, bool]:
        """(number, whether it is only told by a cue)."""
        r, d = self.rng, self.digits
        area = r.choice("23456789") + d(2)
        form = r.randrange(10)
        if form < 3:
            return f"+{r.choice(['1', '44', '49', '33', '34'])} " + r.choice([f"({area}) {d(3)}-{d(4)}", f"{area} {d(7)}", f"{d(2)} {d(3)} {d(4)}", f"{area}/{d(3)}-{d(4)}"]), False
        if form < 6:
            return r.choice([f"({area}) {d(3)}-{d(4)}", f"({area}) {d(3)} {d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}"]), False
        if form < 8:
            return r.choice([f"00{r.choice(['1', '44', '49', '33'])} {area} {d(6)}", f"(0{d(3)}) {d(7)}", f"0{d(3)}/{d(7)}"]), False
        return r.choice([area + d(7), f"0{d(3)} {d(6)}", f"{area} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]), True

    def iban(self) -> str:
        r = self.rng
        country, size = r.choice([("DE", 18), ("FR", 23), ("ES", 20), ("NL", 14), ("GB", 18)])
        body = (self.digits(size) if country not in ("NL", "GB") else "ABNA" + self.digits(size - 4))[:size]
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        packed = f"{country}{98 - number % 97:02d}{body}"
        return packed if r.random() < 0.5 else " ".join(packed[i : i + 4] for i in range(0, len(packed), 4))

    def ssn(self) -> tuple[str, bool]:
        r = self.rng
        parts = (str(r.randint(100, 665)), f"{r.randint(1, 99):02d}", f"{r.randint(1, 9999):04d}")
        return ("-".join(parts), False) if r.random() < 0.6 else (r.choice([" ", ""]).join(parts), True)

    def personal(self) -> tuple[str, str, str]:
        """(kind, cue or nothing, value)."""
        kind, needs = self.rng.choice(KINDS), False
        value = getattr(self, kind)()
        if isinstance(value, tuple):
            value, needs = value
        return kind, self.cue(CUES[KINDS.index(kind)]) if needs or self.rng.random() < 0.5 else "", value

    def cue(self, words: tuple[str, ...]) -> str:
        word = self.rng.choice(words)
        return self.rng.choice([word, word.capitalize(), word.upper()]) + self.rng.choice([" ", ": ", " is ", ":", " = "])

    def look_alike(self) -> tuple[str, str]:
        """(cue or nothing, value)."""
        r, d = self.rng, self.digits
        month, day, year = f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}", str(r.randint(1900, 2035))
        card = d(16)
        while luhn(card):
            card = d(16)
        value = r.choice(
            [
                f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{year}{month}{day}", f"{year}-{month}-{day} {d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{day}.{month}.{year} - {day}.{month}.{year}",
                f"{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}.{r.randint(256, 999)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}",
                d(7), d(8), d(9), d(10), d(11), d(12), d(13), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{year} {year} {year} {year}", f"{d(2)}.{d(6)}, -{d(2)}.{d(6)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(5)}", f"{d(4)}/{d(2)}/{d(4)}", f"@{self.name()}", f"{self.name()}@localhost",
                f"@{self.name()}.{self.name()}", f"meet at {self.name()} dot {self.name()}"[: r.choice([14, 60])], f"aa:{d(2)}:bb:{d(2)}", f"{d(1)}::{d(1)}", f"AB{d(2)} {d(4)} {d(4)} {d(4)}", f"{r.choice('ABCX')}{d(1)}-{d(7)}", f"{d(5)} {d(5)} {d(5)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
            ]
        )
        return self.cue(CUES[-1]) if r.random() < 0.4 else "", value


def planted(text: str, seed: int, many: int = 4) -> tuple[str, list[Span]]:
    """``text`` with made-up personal data and look-alikes at word borders, and the spans of the former."""
    maker = _Maker(seed)
    words = text.split(" ")
    places = sorted(maker.rng.randrange(len(words) + 1) for _ in range(2 * many))
    out, size, spans, done = [], 0, [], 0
    for k, at in enumerate(places):
        kind, cue, value = maker.personal() if k % 2 else ("", *maker.look_alike())
        head = " ".join(words[done:at]) + maker.rng.choice([" ", " ", "\n"]) + cue
        done = at
        begin = size + len(head)
        piece = head + value + maker.rng.choice(["", "", "", ".", ",", ";", "!", ")", "\n"]) + " "
        if kind:
            spans.append((kind, begin, begin + len(value)))
        out.append(piece)
        size += len(piece)
    return "".join(out) + " ".join(words[done:]), spans


@dataclass
class Model:
    """Trees of bounded size and a threshold for each kind; it travels with the tasks."""

    trees: boosting.Boosted | forest.Forest
    threshold: dict[str, float]


def _examples(texts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds, whether held out) of the candidates of planted texts."""
    xs, ys, kinds, held = [], [], [], []
    for seed, text in texts:
        text, true = planted(text, seed)
        spans = candidates(text)
        right = {*true, *base_spans(text)}
        xs.append(features(text, spans))
        ys += [s in right for s in spans]
        kinds += [KINDS.index(s[0]) for s in spans]
        held += [seed % 4 == 3] * len(spans)
    return np.concatenate([x for x in xs if len(x)]), np.array(ys), np.array(kinds), np.array(held)


def fit(texts: list[str], min_precision: float = MIN_PRECISION) -> Model:
    """A model from a few texts, on one machine: boosted trees, and thresholds from every fourth text.  ``train`` is for tables."""
    texts = [t for t in texts if t] or list(FILLER) * 100
    while len(texts) < 200:  # a small sample is planted more often
        texts = texts * 2
    x, y, kinds, held = _examples(list(enumerate(texts)))
    trees = boosting.fit(x[~held], y[~held].astype(float))
    p = trees.probability(x[held])
    threshold = {}
    for k, kind in enumerate(KINDS):
        mine = kinds[held] == k
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[held][mine][order])
        good = np.flatnonzero(right >= min_precision * np.arange(1, len(order) + 1))
        threshold[kind] = max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.1
    return Model(trees, threshold)


def examples(docs: DataFrame) -> DataFrame:
    """(kind, label, held, codes) of the candidates of every text of ``docs``, planted with one of each sort, and of the filler."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("seed"), text.alias("text"), F.lit(1).alias("many"))
    filler = docs.sparkSession.range(0, FILLER_ROWS, 1, 1).select(F.xxhash64("id").alias("seed"), F.when(F.col("id") % 2 == 0, FILLER[0]).otherwise(FILLER[1]).alias("text"), F.lit(4).alias("many"))

    def run(batches):
        for batch in batches:
            seeds, many, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.schema.get_field_index("text")
            for lo, hi in slices(batch.column(at)):
                xs, kinds, labels, held = [], [], [], []
                for seed, text, n in zip(seeds[lo:hi], batch.column(at)[lo:hi].to_pylist(), many[lo:hi]):
                    text, true = planted(text, seed, n)
                    spans = candidates(text)
                    right = {*true, *base_spans(text)}
                    for begin in range(0, len(spans), _MOST):  # a text may have very many
                        mine = spans[begin : begin + _MOST]
                        xs.append(forest.codes(features(text, mine)))
                        labels += [s in right for s in mine]
                        kinds += [KINDS.index(s[0]) for s in mine]
                        held += [seed % 4 == 3] * len(mine)
                        if len(kinds) >= _MOST:
                            yield _batch(kinds, labels, held, xs)
                            xs, kinds, labels, held = [], [], [], []
                if kinds:
                    yield _batch(kinds, labels, held, xs)
        trim()

    return rows.unionByName(filler).mapInArrow(run, "kind int, label boolean, held boolean, codes array<tinyint>")


_MOST = 1 << 14


def _batch(kinds: list[int], labels: list[bool], held: list[bool], xs: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate([x for x in xs if len(x)])
    coded = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(labels), pa.array(held), coded], ["kind", "label", "held", "codes"])


#: Held-out probabilities are counted in so many steps.
STEPS = 1000


def train(docs: DataFrame, min_precision: float = MIN_PRECISION) -> Model:
    """A model from all documents: a forest from three of four, thresholds from the counts of the others."""
    rows = written(examples(docs))
    trees = forest.fit(rows.where("not held"), features("1", [("ssn", 0, 1)]).shape[1])
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def judge(batches):
        n = np.zeros((len(KINDS) * (STEPS + 1), 2), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            step = np.floor(shared.value.judged(coded) * STEPS).astype(np.int64)
            key = batch.column(0).to_numpy() * (STEPS + 1) + step
            label = batch.column(1).to_numpy(zero_copy_only=False)
            n += np.stack([np.bincount(key, minlength=len(n)), np.bincount(key[label], minlength=len(n))], axis=1)
        seen = np.flatnonzero(n[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(seen // (STEPS + 1)), pa.array(seen % (STEPS + 1)), pa.array(n[seen, 0]), pa.array(n[seen, 1])], ["kind", "step", "n", "good"])

    counts = rows.where("held").select("kind", "label", "codes").mapInArrow(judge, "kind long, step long, n long, good long")
    found = counts.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("kind", F.desc("step")).collect()  # kinds x steps at most
    threshold = dict.fromkeys(KINDS, 1.1)
    n, good = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for r in found:
        kind = KINDS[r.kind]
        n[kind] += r.n
        good[kind] += r.good
        if good[kind] >= min_precision * n[kind]:
            threshold[kind] = max(0.5, r.step / STEPS)
    return Model(trees, threshold)


def select(text: str, spans: list[Span], p: np.ndarray, threshold: dict[str, float], base: list[Span]) -> list[tuple[str, int, int, float, bool]]:
    """Base spans and the probable others, without overlap: the more probable, then the longer, then the earlier one stays."""
    taken, out = [(a, b) for _, a, b in base], [(*s, 1.0, True) for s in base]
    order = sorted((i for i, s in enumerate(spans) if p[i] >= threshold[s[0]]), key=lambda i: (-p[i], spans[i][1] - spans[i][2], _place(spans[i])))
    free = np.ones(len(text) + 1, dtype=bool) if order else None
    for a, b in taken if order else ():
        free[a:b] = False
    for i in order:
        kind, a, b = spans[i]
        if free[a:b].all():
            free[a:b] = False
            out.append((kind, a, b, float(p[i]), False))
    return sorted(out, key=_place)


SPANS = "array<struct<kind:string,begin:int,end:int,p:double,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``spans``: kind, begin, end (code points, end exclusive), probability and whether it is a base span."""
    docs = docs.drop("spans").withColumn("text", F.col("text").cast("string"))
    names, schema = docs.columns, with_fields(docs.drop("spans").schema, f"spans {SPANS}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(at).to_pylist()]
                spans = [candidates(t) for t in texts]
                p, done, found = _judged(texts, spans, m), 0, []
                for text, mine in zip(texts, spans):
                    found.append([dict(zip(("kind", "begin", "end", "p", "base"), s)) for s in select(text, mine, p[done : done + len(mine)], m.threshold, base_spans(text))])
                    done += len(mine)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _SPAN_TYPE)], [*names, "spans"])
        trim()

    return docs.mapInArrow(run, schema)


def _judged(texts: list[str], spans: list[list[Span]], model: Model, most: int = 1 << 16) -> np.ndarray:
    """Probabilities of all candidates, so many rows of features at a time."""
    out, rows, held = [], [], 0
    for text, mine in zip(texts, spans):
        for lo in range(0, len(mine), most):
            rows.append(features(text, mine[lo : lo + most]))
            held += len(rows[-1])
            if held >= most:
                out.append(model.trees.probability(np.concatenate(rows)))
                rows, held = [], 0
    if rows:
        out.append(model.trees.probability(np.concatenate(rows)))
    return np.concatenate(out) if out else np.zeros(0)


def redact(found: DataFrame) -> DataFrame:
    """``find``'s rows with every span in ``text`` replaced by its kind in angle brackets; of overlapping spans the first kind stands for all."""

    def run(batches):
        for batch in batches:
            at, by = batch.schema.get_field_index("text"), batch.schema.get_field_index("spans")
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist()):
                out, end = [], 0
                for s in spans or []:
                    if s["begin"] >= end:
                        out += [text[end : s["begin"]], f"<{s['kind'].upper()}>"]
                    end = max(end, s["end"])
                texts.append(None if text is None else "".join(out) + text[end:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return found.mapInArrow(run, found.schema)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of ``find``'s rows."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

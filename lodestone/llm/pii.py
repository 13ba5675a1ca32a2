"""Personal data: four fixed patterns, and a skip-chain conditional random field.

A text's tokens are its runs of TOKEN characters, of any length. The field's nodes are the
distinct tokens that hold a digit or an @, and those that are the local part of one of the
text's addresses. All places of a repeated token are one node: they share its label and
pool what speaks for it, whatever their number, so a document never labels a token in two
ways. Nodes have features of their own; tokens that follow one another share potentials,
and so do distant ones that resemble each other (an address and its bare local part, or
the same last digits). Sum-product messages go round these loops until they settle, so
that a number that is doubtful where it stands takes the label of its clear counterpart
elsewhere. Weights are trained by pseudo-likelihood on labelled samples. Tokens labelled
as personal data that touch no pattern's span are added as crf_* spans, at every place;
the patterns' spans stay.

Documents are independent; one narrow pass reads whole texts, and all nodes of a chunk
exchange messages at once. Tokens that resemble each other are linked to the first of
them, so links grow with the tokens however often one repeats.

Defined results: null text is as empty (no spans); repeated rows each get their own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Base kinds in the order of the digest; the field's come after them.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)

# fixed values: the patterns, written so that they cannot go back over long runs; email is put together around its @
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: Messages have settled when none moves by more than this, in log-odds; should loops keep them swinging, damping grows until they do.
SETTLED = 1e-4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# fixed values: words that announce personal data, by label, and local parts that name a role and no person
_CUES = {
    "email": "mail email e-mail contact write reply address correo courriel",
    "ip": "ip host server client address from",
    "card": "card visa mastercard credit debit payment tarjeta carte karte",
    "phone": "phone tel telephone call mobile fax cell ring text teléfono téléphone telefon",
}
_CUED = {w: k for k, words in _CUES.items() for w in words.split()}
_ROLES = frozenset("abuse accounts admin billing careers contact editor feedback hello help hr info jobs legal mail marketing media news newsletter noreply office orders press privacy sales security service shop support team web webmaster".split())
FEATURES = (
    "bias at at_domain plus digits_1 digits_3 digits_5 digits_7 digits_9 digits_13 digits_20 dots_1 dots_2 dots_3 hyphen hyphens paren letters only_digits "
    "quad luhn not_luhn cue_email cue_ip cue_card cue_phone date money before_plus phone_shape slash parted plain role"
).split()
_AT = {n: k for k, n in enumerate(FEATURES)}
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.][0-9]{1,2}[-/.][0-9]{1,2})?$|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}$|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$")
_PHONE_SHAPE = re.compile(r"(?:[0-9]{3}[-.]?)?[0-9]{3}[-.][0-9]{4}$")
_NOT_DIGITS = {c: None for c in range(128) if not 48 <= c <= 57}

#: Characters of tokens; others end them. What is stripped from a token's ends.
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+-:/$#&*~"
_EDGES = ".-:/#&*~%_"
_OF_TOKEN = np.zeros(256, bool)
_OF_TOKEN[[ord(c) for c in TOKEN]] = True
_INNER = _OF_TOKEN.copy()
_INNER[[ord(c) for c in _EDGES]] = False

#: What a place of a token is labelled by: the token, the word before it, whether that word is the token before it, and whether brackets or a currency sign touch it.
Place = tuple[str, str, bool, str]


def features(token: str, before: str, previous: str, around: str) -> list[int]:
    """Indices of the features of a token at one place; previous is the token before it, where that is next to it."""
    digits = token.translate(_NOT_DIGITS)
    n = len(digits)
    on = ["bias"]
    on += [f"digits_{k}" for k, to in ((1, 3), (3, 5), (5, 7), (7, 9), (9, 13), (13, 20), (20, 1 << 62)) if k <= n < to]
    at, dots, hyphens = token.find("@"), token.count("."), token.count("-")
    if at >= 0:
        on += ["at"] + ["at_domain"] * (0 < at and "." in token[at:])
    on += ["plus"] * token.startswith("+") + [f"dots_{min(dots, 3)}"] * (dots > 0) + ["hyphen"] * (hyphens == 1) + ["hyphens"] * (hyphens > 1)
    on += ["paren"] * ("(" in around) + ["slash"] * ("/" in token)
    letters = bool(_LETTER.search(token))
    on += ["letters"] * letters + ["only_digits"] * (n == len(token))
    core = token.split(":")[0].split("/")[0].split(".")
    on += ["quad"] * (len(core) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in core))
    if 13 <= n <= 19 and not letters:
        on.append("luhn" if luhn(digits) else "not_luhn")
    cue = _CUED.get(before.strip(".,:;()").lower())
    on += [f"cue_{cue}"] * (cue is not None) + ["date"] * (len(token) <= 10 and bool(_DATE.match(token))) + ["money"] * ("$" in around or token[0] == "$")
    on += ["before_plus"] * previous.startswith("+") + ["phone_shape"] * (n in (7, 10) and bool(_PHONE_SHAPE.match(token)))
    if letters and at < 0:
        on.append("role" if token.lower() in _ROLES else "parted" if n or any(c in token for c in "._-") else "plain")
    return [_AT[x] for x in on]


def keys(token: str) -> list[str]:
    """What distinct tokens share that resemble each other: an address's local part, the last digits."""
    low = token.lower()
    local = low.partition("@")[0]
    out = [local] if len(local) >= 4 else []
    digits = token.translate(_NOT_DIGITS)
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    return out


class Graph:
    """Nodes of any number of documents, one for each distinct token of a document, with their features and links."""

    def __init__(self) -> None:
        self.on: list[set[int]] = []
        self.links: tuple[set, set, set] = (set(), set(), set())  # next to each other, further apart, resembling each other

    def document(self, places: list[Place]) -> list[int]:
        """The nodes of the places. Case is no difference, as local parts and hosts have none."""
        node: dict[str, int] = {}
        first: dict[str, int] = {}
        out: list[int] = []
        for k, (token, before, joined, around) in enumerate(places):
            low = token.lower()
            me = node.get(low)
            if me is None:
                me = node[low] = len(self.on)
                self.on.append(set())
                for key in keys(token):
                    if first.setdefault(key, me) != me:
                        self.links[2].add((first[key], me))
            self.on[me].update(features(token, before, places[k - 1][0] if joined and k else "", around))
            if k and out[-1] != me:
                self.links[0 if joined else 1].add((out[-1], me))
            out.append(me)
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features and their nodes, links' ends, kinds and weights.

        However many places a token has, the tokens around it weigh no more than those of one place.
        """
        on = np.array([f for one in self.on for f in sorted(one)], np.int64)
        owner = np.repeat(np.arange(len(self.on)), [len(one) for one in self.on])
        ends = np.array([p for kind in self.links for p in sorted(kind)], np.int64).reshape(-1, 2)
        kind = np.repeat(np.arange(3), [len(kind) for kind in self.links])
        beside = np.maximum(np.bincount(ends[kind < 2].ravel(), minlength=len(self.on)), 2)
        return on, owner, ends, kind, np.where(kind < 2, 2 / beside[ends].max(axis=1), 1.0) if len(ends) else np.empty(0)


def _scores(on: np.ndarray, owner: np.ndarray, unary: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, unary[on, k], n) for k in range(unary.shape[1])], axis=1)


def _into(target: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(target, rows[:, k], n) for k in range(rows.shape[1])], axis=1)


class Field:
    """Weights of the features by label, and a table of potentials for each kind of link."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair

    def marginals(self, on: np.ndarray, owner: np.ndarray, ends: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum-product, all messages at once, until they settle."""
        n = int(owner[-1]) + 1 if len(owner) else 0
        belief = local = _scores(on, owner, self.unary, n)
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        table = np.concatenate([self.pair, self.pair.transpose(0, 2, 1)])[np.concatenate([kind, kind + 3])] * np.tile(weight, 2)[:, None, None]  # [message, from, to]
        message = np.zeros((len(source), local.shape[1]))
        # only messages whose sources' beliefs still move are sent again
        moving = np.arange(len(source))
        new_share, rounds = 1.0, 0
        while len(moving):
            out = (belief[source[moving]] - message[back[moving]])[:, :, None] + table[moving]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            step = new_share * (new - message[moving])
            message[moving] += step
            belief = local + _into(target, message, n)
            moved = np.zeros(n, bool)
            moved[target[moving[np.abs(step).max(axis=1) > SETTLED]]] = True
            moving = np.flatnonzero(moved[source])
            rounds += 1
            if rounds % 16 == 0:
                new_share *= 0.7
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def train(samples: list[list[tuple[Place, int]]], steps: int = 400) -> Field:
    """Pseudo-likelihood over labelled documents; each a list of (place, label)."""
    graph = Graph()
    label: dict[int, int] = {}
    for document in samples:
        for node, (_, told) in zip(graph.document([place for place, _ in document]), document):
            label[node] = max(told, label.get(node, 0))
    on, owner, ends, kind, weight = graph.arrays()
    hot = np.eye(len(LABELS))[[label[k] for k in range(len(label))]]
    unary, pair = np.zeros((len(FEATURES), len(LABELS))), np.zeros((3, len(LABELS), len(LABELS)))
    n = len(hot)
    rate = 4.0 / n
    for _ in range(steps):
        score = _scores(on, owner, unary, n)
        table = pair[kind] * weight[:, None, None]
        score += _into(ends[:, 1], np.einsum("ef,efg->eg", hot[ends[:, 0]], table), n)
        score += _into(ends[:, 0], np.einsum("eg,efg->ef", hot[ends[:, 1]], table), n)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = hot - p / p.sum(axis=1, keepdims=True)
        push = (np.einsum("ef,eg->efg", hot[ends[:, 0]], off[ends[:, 1]]) + np.einsum("ef,eg->efg", off[ends[:, 0]], hot[ends[:, 1]])) * weight[:, None, None]
        unary += rate * _into(on, off[owner], len(FEATURES)) - 1e-4 * unary
        pair += rate / 2 * _into(kind, push.reshape(-1, len(LABELS) ** 2), 3).reshape(pair.shape) - 1e-4 * pair
    return Field(unary, pair)


def labelled_samples(n: int = 1000, seed: int = 5) -> list[list[tuple[Place, int]]]:
    """Labelled documents by rule: contact data in forms that the patterns know and that they miss, with numbers of other kinds between."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    words = "the of and at item page in with about year room order lines that de la und le".split()
    word = lambda: words[rng.integers(len(words))]
    roles = sorted(_ROLES)

    def card() -> str:
        head = "4" + number(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def no_card() -> str:
        digits = number(16)
        return digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)

    def local() -> str:
        forms = (f"{letters(6)}.{number(2)}", f"{letters(4)}.{letters(6)}", f"{letters(1)}{letters(7)}", f"{letters(5)}_{letters(5)}", f"{letters(6)}{number(2)}", roles[rng.integers(len(roles))])
        return forms[rng.integers(len(forms))]

    out = []
    for _ in range(n):
        document: list[tuple[Place, int]] = []
        phone, name = [str(rng.integers(200, 999)), str(rng.integers(200, 999)), number(4)], local()
        has = rng.random(4) < 0.5
        bare = 0 if not has[0] or name in _ROLES else 1
        for _ in range(rng.integers(2, 9)):
            pick = rng.integers(13)
            plain = [number(int(rng.integers(1, 5))), str(rng.integers(1900, 2030)), f"20{number(2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", f"${number(3)}", f"{number(1)}.{number(1)}.{number(2)}", number(7), f"{number(2)}%", number(int(rng.integers(20, 30))), f"A{number(5)}", f"{number(2)}:{number(2)}"]
            cue = rng.random() < 0.2
            if pick < 5:
                document.append(((plain[rng.integers(len(plain))], word(), False, ""), 0))
            elif pick == 5 and has[0]:
                document.append(((f"{name}@mail{number(1)}.example.com", "write" if cue else word(), False, ""), 1))
                # a bare name is a node only beside its address, and personal unless it names a role
                document += [((name, word(), False, ""), bare)] * int(rng.integers(0, 3))
            elif pick == 6 and name[-1].isdigit():
                document.append(((name, word(), False, ""), bare))
            elif pick == 7 and has[1]:
                document.append(((".".join(str(rng.integers(1, 256)) for _ in range(4)) + (":" + number(4)) * int(rng.random() < 0.3), "host" if cue else word(), False, ""), 2))
            elif pick == 8 and has[2]:
                document.append(((card(), "card" if cue else word(), False, ""), 3))
            elif pick == 9 and has[3]:
                shape = rng.integers(3)
                if shape == 0:
                    document += [(("+1", word(), False, ""), 4), ((phone[0], "+1", True, "("), 4), ((f"{phone[1]}-{phone[2]}", phone[0], True, ""), 4)]
                elif shape == 1:
                    document += [((phone[0], "call", False, "("), 4), ((f"{phone[1]}-{phone[2]}", phone[0], True, ""), 4)]
                else:
                    document.append((("-".join(phone), word(), False, ""), 4))
            elif pick == 10 and has[3]:
                document.append(((phone[1] + phone[2], word(), False, ""), 4 if any(label == 4 for _, label in document) else 0))
            elif pick == 11:
                document.append(((no_card(), word(), False, ""), 0))
            elif pick == 12:
                document.append(((str(rng.integers(100, 999)), word(), False, "("), 0))
        # an address that follows its bare name counts for it too
        address = any(label == 1 and "@" in place[0] for place, label in document)
        if document:
            out.append([(place, label if address or label != 1 else 0) for place, label in document])
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token, less what is stripped, and the index of its text."""
    starts, ends, owner = common.find_words(data, offsets, _OF_TOKEN)
    if not len(starts):
        return starts, ends, owner
    at = np.arange(len(data))
    inner = _INNER[data]
    before = np.maximum.accumulate(np.where(inner, at, -1))
    after = np.minimum.accumulate(np.where(inner, at, len(data))[::-1])[::-1]
    some = after[starts] < ends
    starts, ends, owner = starts[some], ends[some], owner[some]
    return after[starts], before[ends - 1] + 1, owner


def _nodes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which tokens hold a digit or an @, or are the local part of an address in their text."""
    held = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    marked = held[ends] > held[starts]
    sign = np.flatnonzero(data == 64)
    if not len(sign) or not len(starts):
        return marked
    first = np.searchsorted(sign, starts)
    at = sign[np.minimum(first, len(sign) - 1)]
    address = (at > starts) & (at < ends - 1) & (first < len(sign))
    sums = common.prefix_sums(data)
    with np.errstate(over="ignore"):
        salt = common.mix(owner.astype(np.uint64) + np.uint64(1))
        locals_ = common.span_hash(sums, starts[address], at[address]) + salt[address]
        whole = common.span_hash(sums, starts, ends) + salt
    return marked | np.isin(whole, locals_) & (ends - starts >= 4)


def _scan(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        data, offsets = common.text_bytes(batch.column("text"))
        starts, ends, owner = tokens(data, offsets)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = points[offsets[:-1]]
        low, high = (points[x] - base[owner] for x in (starts, ends))
        graph = Graph()
        place: list[tuple[int, int, int, bool, int]] = []  # document, start, end, joined, node
        at = np.flatnonzero(_nodes(data, starts, ends, owner)).tolist()
        cuts = np.searchsorted(owner[at], np.arange(len(texts) + 1)) if at else np.zeros(len(texts) + 1, np.int64)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            text, own, places = texts[d], at[cuts[d] : cuts[d + 1]], []
            last = -2
            for k in own:
                s, e = int(low[k]), int(high[k])
                first = k == 0 or owner[k - 1] != d
                gap = "" if first else text[int(high[k - 1]) : s] if s - int(high[k - 1]) <= 4 else "\n\n\n"
                joined = last == k - 1 and not first and len(gap) <= 3 and "\n" not in gap
                before = (text[max(0, s - 40) : s].split() or [""])[-1]
                around = text[s - 1 : s] + text[e : e + 1]
                places.append((text[s:e], before, joined, around.replace("€", "$").replace("£", "$").replace(")", "(")))
                place.append((d, s, e, joined, 0))
                last = k
            nodes = graph.document(places)
            place[-len(nodes) :] = [(*x[:4], node) for x, node in zip(place[-len(nodes) :], nodes)]
        added: dict[int, list[tuple[int, int, int]]] = {}
        if place:
            label = field.value.marginals(*graph.arrays())
            best, sure = label.argmax(axis=1).tolist(), (label.max(axis=1) > 0.5).tolist()
            for d, s, e, joined, node in place:
                k = best[node] - 1
                if k >= 0 and sure[node]:
                    spans = added.setdefault(d, [])
                    if joined and spans and spans[-1][0] == k and s - spans[-1][2] <= 3 and k == 3:
                        spans[-1] = (k, spans[-1][1], e)
                    else:
                        spans.append((k, s, e))
        out: list[list] = [[] for _ in range(6)]
        for d, text in enumerate(texts):
            base_ = base_spans(text)
            told = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base_)
            begin = sorted((s, e) for _, s, e in base_)
            reach = [0, *accumulate((e for _, e in begin), max)]  # the furthest end of the first spans
            more = [x for x in added.get(d, []) if reach[bisect_left(begin, (x[2], -1))] <= x[1]]
            for k in range(4):
                out[k].append(sum(b[0] == k for b in base_))
            out[4].append(hashlib.sha256(told.encode()).hexdigest())
            out[5].append(",".join([told] * bool(told) + [f"crf_{KINDS[k]}:{s}:{e}" for k, s, e in sorted(more)]))
        names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, kinds))], names=names)


def report(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_samples()))
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"))
    fields = [T.StructField("id", made.schema["id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), *(T.StructField(c, T.StringType()) for c in ("base_sha256", "spans"))]
    return made.mapInArrow(lambda it: _scan(it, shared), T.StructType(fields)).withColumnRenamed("id", id_col)

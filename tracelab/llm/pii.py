"""Personal data: pattern spans plus a linear-chain CRF over word-shape features.

Base spans (e-mail, IP, card, phone) come from fixed patterns with checks (octets, Luhn, digit counts). A conditional
random field adds what the patterns can't see: national phone numbers, addresses written with "at" and "dot", IPs with
bracketed dots, cards with odd separators. Tokens are letter and digit runs and single marks; features are the shapes
of the tokens at offsets -2..2 and whether a token touches the one before it. It is trained on the driver from a small
labelled table (TABLE, its slots filled by a seeded rule) by gradient ascent of the likelihood.

Decoding is exact Viterbi over whole texts, in numpy batches. A token can be in a span of the best path only if some
interval around it has a positive sum of its tokens' best gains over "outside" plus the largest transition gain; that
test is a running-minimum over prefix sums. All other tokens are "outside" on a best path, so only the remaining runs
are decoded, all runs of one length together, with "outside" on both ends. Decoded spans must pass the same checks as
base spans and must not overlap one; base spans always stay.

Edge cases: a null text is an empty one, without spans; repeated rows get equal spans; ties keep the pattern order of
KINDS; an empty table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column, word_keys

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ DOMAIN, found from each @ so that long words cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- tokens and shapes

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
UPPERS = np.zeros(256, bool)
UPPERS[65:91] = True
MARKS = b".,@+()[]{}-_/:;'\"#%&*=<>|!?$~"
N_LETTER, N_DIGIT = 6, 11
CUES = ("at", "dot", "AT", "DOT", "tel", "phone", "call", "fax", "mail", "card")
SHAPES = 3 + N_LETTER + N_DIGIT + len(MARKS) + len(CUES)  # 0: outside the text or a line end, 1: any other mark, last: a dot inside a word
MARK_SHAPE = np.ones(256, np.int64)
MARK_SHAPE[list(MARKS)] = 2 + N_LETTER + N_DIGIT + np.arange(len(MARKS))


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_keys(data, np.array([0]), np.array([len(data)]))[0])


PLAIN = np.zeros(SHAPES, bool)
PLAIN[[0, *range(2, 2 + N_LETTER), MARK_SHAPE[44], MARK_SHAPE[46]]] = True
CUE_HASH = {_hash_of(c): 2 + N_LETTER + N_DIGIT + len(MARKS) + i for i, c in enumerate(CUES)}


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape, touches) of all tokens; line feeds and text starts are tokens of shape 0."""
    kind = np.where(DIGITS[data], 2, np.where(LETTERS[data], 1, np.where((data == 32) | ((data >= 9) & (data <= 13) & (data != 10)), 0, 3)))
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    cut = off[:-1][off[:-1] < len(data)]
    new[cut] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    k, size = kind[start], end - start
    lines = data[start] == 10
    shape = np.where(k == 3, MARK_SHAPE[data[start]], 0)
    first, last = UPPERS[data[start]], UPPERS[data[end - 1]]
    letter = np.where(size == 1, np.where(first, 0, 1), np.where(first & last, 2, np.where(first, 3, np.where(size <= 3, 4, 5))))
    digit = np.where(size <= 6, size - 1, np.where(size <= 8, 6, np.where(size <= 11, 7, np.where(size <= 16, 8, np.where(size <= 19, 9, 10)))))
    shape = np.where(k == 1, 2 + letter, np.where(k == 2, 2 + N_LETTER + digit, shape))
    short = np.flatnonzero((k == 1) & (size <= 5))
    if len(short):
        h = word_keys(data, start[short], end[short])
        for value, cue in CUE_HASH.items():
            shape[short[h == np.uint64(value)]] = cue
    shape[lines] = 0
    inner = np.flatnonzero((data[start[1:-1]] == 46) & (start[1:-1] == end[:-2]) & (end[1:-1] == start[2:]) & (k[:-2] < 3) & (k[2:] < 3)) + 1 if len(start) > 2 else []
    shape[inner] = SHAPES - 1
    touches = np.zeros(len(start), bool)
    touches[1:] = start[1:] == end[:-1]
    # a break before each text that has tokens, so that no sequence crosses texts
    heads = np.unique(np.searchsorted(start, off[1:-1], "left"))
    return np.insert(start, heads, -1), np.insert(end, heads, -1), np.insert(shape, heads, 0), np.insert(touches, heads, False)


# ---------------------------------------------------------------- the labelled table

TABLE = (
    "Call me at [phone:(###) ###-####] today", "You can phone [phone:###-###-####] after noon", "tel [phone:(###) ### ####]", "fax: [phone:###.###.####] or mail us", "Reach the desk on [phone:(0##) #### ####].",
    "My number is [phone:+# (###) ###-####] now", "ring [phone:+## ### #######] please", "Write to [email:aaaa@aaaaa.aaa] soon", "mail [email:aaa.aaaa@aaaa.aaa.aaa] today", "It is [email:aaaaa (at) aaaaa (dot) aaa] here", "Send it to [email:aaaa at aaaaa dot aaa] please",
    "contact [email:aaaa [at] aaaaaa [dot] aa] now", "reach [email:aaa.aaaa (at) aaaa (dot) aaa].", "The host [ip:##.###.#.##] is down", "from [ip:###.##.##.#] to here", "seen [ip:##[.]##[.]#[.]###] in logs", "server [ip:###[.]###[.]#[.]##] fell",
    "Card [card:#### #### #### ####] was used", "pay with [card:####-####-####-####] now", "card [card:####.####.####.####] again", "number [card:################] on file", "use card [card:####/####/####/####] here",
    "In #### there were ## people and ### dogs", "It cost ##.## in the shop", "Version #.#.# of the tool", "On ##.##.#### we met", "On ##/##/#### they left", "Between ####-#### it grew", "See pages ###-### and ##", "The year ####.", "Item ##### of ######## is late",
    "token = \"a#a###a#aa####a#\" was set", "We met at noon. The dot was red, at last", "He is at home (at last) and well", "Look at aaaa dot or line", "aaaaa (aaa) aaaa [aaa] aaaa", "Aaaa aaa, aaaa aaaaaa. Aaaa aaaa; aaa!", "aaa | aaaa | aaaaa", "AAAA!! AAA!! AAAAA!!", "aaa### aaaa$$$ aa%%% aaa&&&",
    "ratio #:## and ## - ## = #", "call # of ## at ##:##", "Order ######-## shipped", "a+b = c (see #)", "id ################## logged", "section #.#.#.#.# ends", "aaaa aa aaaaaa at aaa aaaa of aaaaa", "Aaaaaa aaaaa aaaaaaaa. aaa aa", "phone the shop at once", "the card is on the mail desk", "(###) items at ### each", "aaaa-aaaa aaa's aaa/aaa",
)
#: How each kind may be written, and the places in a sentence where each of these is put.
FORMATS = {
    "email": ("aaaaa (at) aaaaa (dot) aaa", "aaaa at aaaaa dot aaa", "aaaa[at]aaaaaa.aaa", "aaaa.aaa [at] aaaaaa [dot] aa", "aaaaa(at)aaaaaa.aaa", "aaaa AT aaaaa DOT aaa"),
    "ip": ("##[.]##[.]#[.]###", "###[.]###[.]#[.]##", "##(.)###(.)##(.)#", "##.###.#.##"),
    "card": ("#### #### #### ####", "####-####-####-####", "####.####.####.####", "####/####/####/####", "####_####_####_####", "################"),
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "0## #### ####", "(0##) ### ####", "0###/######", "### ### ####", "+# (###) ###-####"),
}
FRAMES = ("{}", "{} aaaa aa aaaaa", "aaaa aaa {}", "Aaaa aaaaa aaa {} aaaaa aa aaa.", "Aaaaa: {}.", "aaa aaaa ({}) aaaa", "aaaa aa {}, aaa aaaaa", "Aaa aaaa {}; aaaa")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]


#: Each format in every place.
MADE = tuple(frame.format(f"[{kind}:{body}]") for kind, bodies in FORMATS.items() for body in bodies for frame in FRAMES)


def labelled(copies: int = 3, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table: (text, [(start, end, kind number)]) with # and runs of a filled by a seeded rule."""
    rng = np.random.default_rng(seed)
    out = []
    for copy in range(copies):
        for line in (*TABLE, *(MADE if copy == 0 else ())):
            text, spans = "", []
            for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[[^\]]*\])*\])", line):
                m = re.fullmatch(r"\[(email|ip|card|phone):(.*)\]", part)
                body = m[2] if m else part
                body = re.sub("#", lambda _: str(rng.integers(1, 10)), body)
                body = re.sub(r"\b[aA]{1,9}\b", lambda x: "".join(chr(rng.integers(97, 123)) for _ in range(rng.integers(max(1, len(x[0]) - 1), len(x[0]) + 3))).capitalize() if x[0][0] == "A" and x[0] != x[0].upper() else x[0].translate({97: chr(rng.integers(97, 123)), 65: chr(rng.integers(65, 91))}), body)
                if m:
                    spans.append((len(text), len(text) + len(body), KINDS.index(m[1])))
                text += body
            out.append((text, spans))
        for _ in range(2 * len(TABLE)):  # plain prose of every shape, and prose with stray numbers and marks: nothing to find
            words = ["".join(chr(rng.integers(97, 123)) for _ in range(rng.integers(1, 9))) for _ in range(rng.integers(3, 14))]
            words = [(str.upper if x < 0.1 else str.capitalize if x < 0.25 else str)(w) + ("." if x > 0.9 else "," if x > 0.8 else "!!" if x > 0.78 else "") for w, x in zip(words, rng.random(len(words)), strict=True)]
            for i in np.flatnonzero(rng.random(len(words)) < rng.choice([0, 0, 0.15])):
                words[i] = str(rng.choice(["at", "dot", "|", "%%%", "***", "(aa)", "-", "7", "42", "1987", "31415", "3.5", "a1b2", "mail", "call", "x@"]))
            out.append((" ".join(words), []))
    return out


class Crf:
    """Weights: shape[5][SHAPES][tags], touch[2][tags], move[tags][tags]."""

    def __init__(self, seed: int = 1):
        t = len(TAGS)
        self.shape, self.touch, self.move = np.zeros((5, SHAPES, t)), np.zeros((2, t)), np.zeros((t, t))
        self.allowed = np.ones((t, t), bool)
        for b, name in enumerate(TAGS):
            if name[0] == "I":
                self.allowed[:, b] = [a in (f"B{name[1:]}", name) for a in TAGS]

    @staticmethod
    def around(shape: np.ndarray) -> np.ndarray:
        """Shapes at offsets -2..2; nothing beyond a break shows."""
        n = len(shape)
        padded = np.concatenate((np.zeros(2, shape.dtype), shape, np.zeros(2, shape.dtype)))
        out = np.stack([padded[i : i + n] for i in range(5)])
        out[0][out[1] == 0] = 0
        out[4][out[3] == 0] = 0
        return out

    @staticmethod
    def barred(around: np.ndarray) -> np.ndarray:
        """What no token may be, whatever the weights: breaks and tokens with nothing but plain ones within two places
        are outside; words are no part of numbers."""
        out = np.zeros((*around.shape[1:], len(TAGS)))
        out[PLAIN[around].all(axis=0) | (around[2] == 0), 1:] = -1e6
        letters = (around[2] >= 2) & (around[2] < 2 + N_LETTER) | (around[2] >= 2 + N_LETTER + N_DIGIT + len(MARKS)) & (around[2] < SHAPES - 1)
        out[letters, 3:] = -1e6
        return out

    def emit(self, around: np.ndarray, touches: np.ndarray) -> np.ndarray:
        out = self.shape[0][around[0]]
        for i in range(1, 5):
            out = out + self.shape[i][around[i]]
        return out + np.where(touches[:, None], self.touch[1], self.touch[0]) + self.barred(around)

    def train(self, table: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.001) -> "Crf":
        seqs = []
        for text, spans in table:
            data = np.frombuffer(text.encode(), np.uint8)
            start, end, shape, touches = tokens(data, np.array([0, len(data)]))
            tag = np.zeros(len(start), int)
            for s, e, k in spans:
                own = np.flatnonzero((start >= s) & (end <= e))
                tag[own], tag[own[0]] = 2 + 2 * k, 1 + 2 * k
            seqs.append((self.around(shape), touches, tag))
        most, n, t = max(len(x[2]) for x in seqs), len(seqs), len(TAGS)
        around, touch, tag, mask = np.zeros((5, n, most), int), np.zeros((n, most), int), np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, (a, g, y) in enumerate(seqs):
            around[:, i, : len(y)], touch[i, : len(y)], tag[i, : len(y)], mask[i, : len(y)] = a, g, y, True
        barred = np.where(self.allowed, 0.0, -1e4)
        bars = self.barred(around)
        params = [self.shape, self.touch, self.move]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gold = np.eye(t)[tag] * mask[:, :, None]
        for r in range(1, rounds + 1):
            e = sum(self.shape[i][around[i]] for i in range(5)) + self.touch[touch] + bars
            move = self.move + barred
            ahead, behind = np.zeros((n, most, t)), np.zeros((n, most, t))
            ahead[:, 0] = e[:, 0] + move[0]
            for j in range(1, most):
                x = ahead[:, j - 1, :, None] + move
                top = x.max(axis=1)
                step = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, j]
                ahead[:, j] = np.where(mask[:, j, None], step, ahead[:, j - 1])
            behind[:, most - 1] = move[:, 0]
            for j in range(most - 2, -1, -1):
                x = move + (e[:, j + 1] + behind[:, j + 1])[:, None, :]
                top = x.max(axis=2)
                step = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
                behind[:, j] = np.where(mask[:, j + 1, None], step, move[:, 0])
            x = ahead[:, -1] + move[:, 0]
            top = x.max(axis=1)
            z = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            p = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
            d = gold - p
            grad = [np.zeros_like(q) for q in params]
            for i in range(5):
                np.add.at(grad[0][i], around[i].ravel(), d.reshape(-1, t))
            np.add.at(grad[1], touch.ravel(), d.reshape(-1, t))
            pair = np.exp(ahead[:, :-1, :, None] + move + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grad[2] = np.einsum("ija,ijb->ab", gold[:, :-1], gold[:, 1:]) - pair.sum(axis=(0, 1))
            grad[2][0] += gold[:, 0].sum(axis=0) - p[:, 0].sum(axis=0)
            final = mask.sum(axis=1) - 1
            grad[2][:, 0] += (gold[np.arange(n), final] - p[np.arange(n), final]).sum(axis=0)
            for q, g, m, v in zip(params, grad, first, second, strict=True):
                g = g / n - decay * q
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
        self.move = self.move + barred
        return self

    def prepare(self) -> "Crf":
        """The largest gain of a transition, for the exact test of which tokens a span may hold."""
        self.swing = max(0.0, float((self.move - self.move[0, 0]).max()))
        return self

    def decode(self, shape: np.ndarray, touches: np.ndarray) -> np.ndarray:
        """A best tag of each token, over all sequences at once."""
        n = len(shape)
        tag = np.zeros(n, np.int64)
        if not n:
            return tag
        odd = ~PLAIN[shape]
        near = odd.copy()
        for k in (1, 2):
            near[k:] |= odd[:-k]
            near[:-k] |= odd[k:]
        around = self.around(shape)
        at = np.flatnonzero(near)
        e = self.emit(around[:, at], touches[at])
        g = np.full(n, -1e6)
        g[at] = (e[:, 1:] - e[:, :1]).max(axis=1) + self.swing
        total = np.concatenate(([0.0], np.cumsum(np.maximum(g, -50.0))))
        best = total[1:] - np.minimum.accumulate(total[:-1])
        back = np.maximum.accumulate(total[1:][::-1])[::-1] - total[:-1]
        live = best + back - np.maximum(g, -50.0) + self.swing > -1e-9
        live &= near & (shape != 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
        s, t = edge[::2], edge[1::2]
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        for size in np.unique(t - s):
            rows = s[t - s == size]
            tok = rows[:, None] + np.arange(size)
            em = e[place[tok]]
            score, came = em[:, 0] + self.move[0], []
            for j in range(1, size):
                x = score[:, :, None] + self.move
                came.append(x.argmax(axis=1))
                score = x.max(axis=1) + em[:, j]
            y = (score + self.move[:, 0]).argmax(axis=1)
            for j in range(size - 1, -1, -1):
                tag[tok[:, j]] = y
                if j:
                    y = came[j - 1][np.arange(len(rows)), y]
        return tag


@cache
def train() -> Crf:
    """The trained field; the table and the rule are fixed, so once for a process is enough."""
    return Crf().train(labelled()).prepare()


def passes(kind: int, text: str) -> bool:
    digits = digits_of(text)
    if kind == 0:
        return "@" in text or bool(re.search(r"\w\W+(?:at|AT)\W+\w.*\W(?:dot|DOT)\W+\w|\w\W+(?:at|AT)\W+\w.*\w\.\w", text))
    if kind == 1:
        return octets(text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def all_spans(crf: Crf, column: pa.Array) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(text, base spans, all spans) of each text."""
    data, off = text_column(column)
    start, end, shape, touches = tokens(data, off)
    tag = crf.decode(shape, touches)
    begin = np.flatnonzero(tag % 2 == 1)
    extra: dict[int, list[tuple[int, int, int]]] = {}
    for i in begin.tolist():
        j = i + 1
        while j < len(tag) and tag[j] == tag[i] + 1:
            j += 1
        owner = int(np.searchsorted(off, start[i], "right")) - 1
        extra.setdefault(owner, []).append((int(start[i] - off[owner]), int(end[j - 1] - off[owner]), int(tag[i] - 1) // 2))
    for row, value in enumerate(column):
        text = value.as_py() or ""
        base = base_spans(text)
        spans = base
        if row in extra:
            raw = text.encode()
            for s, e, kind in extra[row]:
                cs = len(raw[:s].decode("utf-8", "replace"))
                ce = cs + len(raw[s:e].decode("utf-8", "replace"))
                if not any(cs < y and x < ce for x, _, y in base) and passes(kind, text[cs:ce]):
                    spans = sorted([*spans, (cs, kind, ce)])
        yield text, base, spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train())  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, digest, said = [], [], []
            for _, base, spans in all_spans(shared.value, b.column(1)):
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                said.append(written(spans))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.record_batch([b.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digest), pa.array(said)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, overlapping ones merged, replaced by its (first) kind in brackets."""
    out, done, at = [], 0, 0
    while at < len(spans):
        s, kind, e = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < e:
            e = max(e, spans[at][2])
            at += 1
        out += [text[done:s], f"[{KINDS[kind].upper()}]"]
        done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data in text replaced; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            new = [redacted(t, spans) if spans else t for t, _, spans in all_spans(shared.value, b.column(at))]
            keep = b.column(at).is_valid().to_pylist()
            yield b.set_column(at, b.schema.field(at), pa.array([t if k else None for t, k in zip(new, keep, strict=True)], b.column(at).type))

    return docs.mapInArrow(run, docs.schema)

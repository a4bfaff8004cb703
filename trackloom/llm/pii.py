"""Personal data: fixed base rules, and a character BiLSTM with CRF transitions that adds spans.

The network (embedding, forward and backward LSTM, linear layer, CRF) is written and trained in numpy, from
labelled spans in generated sentences: the base formats and ways in which people hide or shorten them. Training
is seeded and takes some seconds on the driver, once for a shared folder, where the weights (some tens of kilobytes) stay; they go to the tasks.

Every whole text is scanned. Kinds that the network knows hold a digit, an ``@`` or a bracketed "at", so
windows of ``WINDOW`` characters are laid every ``STEP`` characters, all that hold a mark and no others; "at" signs also
have one of twice that width around them. Each window is decoded by Viterbi; a span that touches an edge is decoded again in
a window of twice the width, until it does not. The spans of all windows of a text are then reconciled together: of
overlapping ones the span farthest from its window's edges stays. Base spans always stay; a network span that
touches one is dropped, as is one without the digits or signs of its kind.

Null text is empty: no spans. Repeated rows are answered each. Very long texts are decoded in batches.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.common import shared_dir

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Fixed patterns of the contract. Possessive forms and the look-behind match the same text in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]", re.I)
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        small = lambda part: len(own := part.lstrip("0")) <= 3 and int(own or 0) <= 255
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the network -----------------------------------------------------------------------------

WINDOW, STEP = 64, 32
EMBED, HIDDEN = 10, 20
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_SIGNS = " \n@.-+()_%:/,;[]{}<>#"  # each has a class of its own
CLASSES = 2 + 26 + 1 + len(_SIGNS) + 2


def _table() -> np.ndarray:
    table = np.full(128, CLASSES - 2, np.int64)  # other ASCII
    for c in range(26):
        table[97 + c] = table[65 + c] = 2 + c
    table[48:58] = 28
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = 29 + k
    return table


_TABLE = _table()


def encode(text: str) -> np.ndarray:
    """Class of each code point (0 is padding, 1 is unused, the last is beyond ASCII)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(cp < 128, _TABLE[np.minimum(cp, 127)], CLASSES - 1)


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A line of invented words around one or two labelled spans or harmless numbers."""
    pick = rng.choice
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = "eeeaaoiinnttrrsslldhcumpgbfwyvkxzjq"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 9)))
    text, spans = "", []

    def filler() -> None:
        nonlocal text
        for _ in range(rng.randrange(1, 5)):
            w = word()
            w = w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.15 else w
            w = "é" + w if rng.random() < 0.05 else w
            text += w + pick(["", "", "", ",", ".", "!!", " |"]) + pick([" ", " ", " ", "\n"])

    def item() -> tuple[str | None, str]:
        r = rng.random()
        if r < 0.24:
            name, dot = word() + pick(["", ".", "_", "-"]) + pick([word(), digits(2), ""]), pick([".", "."])
            host, top = word() + pick(["", "", digits(1)]), pick(["com", "org", "net", "de", "example.com"])
            if rng.random() < 0.6:
                return "email", f"{name.rstrip('._-')}@{host}{dot}{top}"
            a, d = pick([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" {at} ", " {dot} "), (" <at> ", ".")])
            return "email", f"{word()}{a}{host}{d}{pick(['com', 'org', 'net'])}"
        if r < 0.36:
            return "ip", ".".join(str(rng.randrange(256)) for _ in range(4))
        if r < 0.50:
            sep = pick([" ", "-"])
            return "card", sep.join(digits(4) for _ in range(4)) if rng.random() < 0.8 else f"{digits(4)}{sep}{digits(6)}{sep}{digits(5)}"
        if r < 0.74:
            a, b, c = digits(3), digits(3), digits(4)
            return "phone", pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"00{digits(2)} {a} {b}{c}", f"+{digits(2)}{a}{b}{c}"])
        return None, pick([
            digits(rng.randrange(1, 6)), digits(16), digits(rng.randrange(6, 14)), f"{digits(1)}.{digits(1)}", f"19{digits(2)}-0{digits(1)}-1{digits(1)}", f"version {digits(1)}.{digits(2)}.{digits(1)}",
            f"{digits(2)}:{digits(2)}", f"token = {''.join(rng.choices('0123456789abcdef', k=40))}", f"{digits(1)},{digits(3)},{digits(3)}", f"{word()}{digits(3)}", f"@{word()}", "at", f"§ {digits(3)}-{digits(2)}", f"{digits(4)}/{digits(4)}",
            f"{digits(16)} {digits(16)}",
        ])

    for _ in range(rng.randrange(1, 3)):
        filler()
        kind, value = item()
        if kind:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + pick([" ", " ", ". ", ", ", "\n", "!! ", "; "])
    filler()
    return text, spans


def tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[start:end] = k + 1
        out[start] = k
    return out


def spans_of(row: np.ndarray) -> list[Span]:
    out, start, kind = [], None, None
    for i, t in enumerate([*row, 0]):
        k = (t - 1) // 2 if t else None
        if start is not None and (k != kind or t % 2 == 1):
            out.append((KINDS[kind], start, i))
            start = None
        if t and start is None:
            start, kind = i, k
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """BiLSTM-CRF; ``p`` holds its arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": init(CLASSES, EMBED) * 3, "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        # of both directions, stacked; gates in the order input, forget, output, cell
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"wx": np.stack([init(EMBED, 4 * HIDDEN) for _ in "fb"]), "wh": np.stack([init(HIDDEN, 4 * HIDDEN) for _ in "fb"]), "b": bias}

    def _lstm(self, x: np.ndarray, keep: list | None) -> np.ndarray:
        """x: (direction, time, rows, embed), the second direction's time reversed; one step serves both."""
        p, (_, steps, rows, _) = self.p, x.shape
        xw = x @ p["wx"][:, None] + p["b"][:, None]
        scale = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)
        h = c = np.zeros((2, rows, HIDDEN), np.float32)
        out = np.empty((2, steps, rows, HIDDEN), np.float32)
        for t in range(steps):
            g = np.tanh((xw[:, t] + h @ p["wh"]) * scale)
            gates = 0.5 * g[:, :, : 3 * HIDDEN] + 0.5
            i, f, o = (gates[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            z, old_c, old_h = g[:, :, 3 * HIDDEN :], c, h
            c = f * old_c + i * z
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            if keep is not None:
                keep.append((i, f, o, z, old_c, old_h, th))
        return out

    def scores(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, rows, tags) of windows (rows, time)."""
        one = self.p["emb"][ids.T]
        x = np.stack([one, one[::-1]])
        steps = [] if keep is not None else None
        both = self._lstm(x, steps)
        h = np.concatenate([both[0], both[1, ::-1]], axis=2)
        if keep is not None:
            keep |= {"x": x, "h": h, "steps": steps}
        return h @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi path of each window."""
        s, trans = self.scores(ids), self.p["trans"]
        steps, rows, _ = s.shape
        best, back = s[0], np.empty((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + trans
            back[t] = way.argmax(axis=1)
            best = np.take_along_axis(way, back[t][:, None, :].astype(np.int64), 1)[:, 0] + s[t]
        path = np.empty((rows, steps), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(rows), path[:, t]]
        return path

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradients."""
        keep: dict = {}
        s, trans, p = self.scores(ids, keep).astype(np.float64), self.p["trans"].astype(np.float64), self.p
        steps, rows, _ = s.shape
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + s[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        ds = np.exp(alpha + beta - z[:, None])
        g, r = gold.T, np.arange(rows)
        path = s[np.arange(steps)[:, None], r, g].sum() + trans[g[:-1], g[1:]].sum()
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtrans, (g[:-1], g[1:]), -1.0)
        ds[np.arange(steps)[:, None], r, g] -= 1
        ds = (ds / rows).astype(np.float32)
        out = {"trans": (dtrans / rows).astype(np.float32), "out": keep["h"].reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS), "bias": ds.sum(axis=(0, 1))}
        dh_all = ds @ p["out"].T
        part = np.stack([dh_all[:, :, :HIDDEN], dh_all[::-1, :, HIDDEN:]])
        dh_next, dc = np.zeros((2, rows, HIDDEN), np.float32), np.zeros((2, rows, HIDDEN), np.float32)
        dwh, dg_all = np.zeros_like(p["wh"]), np.empty((2, steps, rows, 4 * HIDDEN), np.float32)
        back = p["wh"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, zc, old_c, old_h, th = keep["steps"][t]
            dh = part[:, t] + dh_next
            dc = dc + dh * o * (1 - th * th)
            dg = dg_all[:, t]
            dg[:, :, :HIDDEN] = dc * zc * i * (1 - i)
            dg[:, :, HIDDEN : 2 * HIDDEN] = dc * old_c * f * (1 - f)
            dg[:, :, 2 * HIDDEN : 3 * HIDDEN] = dh * th * o * (1 - o)
            dg[:, :, 3 * HIDDEN :] = dc * i * (1 - zc * zc)
            dwh += old_h.transpose(0, 2, 1) @ dg
            dh_next, dc = dg @ back, dc * f
        out |= {"wh": dwh, "b": dg_all.sum(axis=(1, 2))[:, None], "wx": keep["x"].reshape(2, -1, EMBED).transpose(0, 2, 1) @ dg_all.reshape(2, -1, 4 * HIDDEN)}
        dx = dg_all @ p["wx"].transpose(0, 2, 1)[:, None]
        dx = dx[0] + dx[1, ::-1]
        out["emb"] = np.zeros_like(p["emb"])
        np.add.at(out["emb"], ids.T, dx)
        return float((z.sum() - path) / rows), out

    def fit(self, steps: int = 260, rows: int = 96, seed: int = 11, rate: float = 0.015) -> Tagger:
        """Adam on freshly generated sentences, cut to windows at random offsets."""
        rng = random.Random(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            ids, gold = np.zeros((rows, WINDOW), np.int64), np.zeros((rows, WINDOW), np.int64)
            for r in range(rows):
                text, spans = _sentence(rng)
                at = rng.randrange(max(1, len(text) - WINDOW + 1))
                part, own = encode(text)[at : at + WINDOW], tags(len(text), spans)[at : at + WINDOW]
                ids[r, : len(part)], gold[r, : len(own)] = part, own
            _, grad = self.gradients(ids, gold)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return Tagger().fit()


def weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """The trained arrays: from the shared folder if this version's are there, else trained and left there for later sessions."""
    own = hashlib.sha256(Path(__file__).read_bytes() + np.__version__.encode()).hexdigest()[:16]
    path, jvm = f"{shared_dir(spark)}/pii-weights-{own}", spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows = spark.read.schema("name string, shape array<int>, body binary").parquet(path).collect()
        return {r.name: np.frombuffer(bytes(r.body), np.float32).reshape(r.shape) for r in rows}
    p = trained().p
    rows = [(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, body binary").coalesce(1).write.mode("overwrite").parquet(path)
    return p


def _plausible(kind: str, value: str) -> bool:
    n = len(_DIGIT.findall(value))
    if kind == "email":
        return bool(re.search(r"@|[\[({<]\s?at\s?[\])}>]", value, re.I)) and len(value) > 5 and bool(re.search(r"\.|dot", value, re.I))
    if kind == "ip":
        return bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value)) and all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= n <= 19 and bool(re.fullmatch(r"\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", value))
    return 9 <= n <= 15 and bool(re.fullmatch(r"[+(0-9][0-9 ().-]*[0-9]", value)) and bool(re.search(r"[+ ().-]", value))


def reconcile(found: list[tuple[int, Span]], base: list[Span]) -> list[Span]:
    """``found``: (distance from the nearest inner window edge, span). Base spans stay; of others that overlap, the most central."""
    held: list[tuple[int, int]] = sorted((s[1], s[2]) for s in base)
    out = list(base)
    for _, span in sorted(found, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1][1], x[1][0])):
        if all(span[2] <= a or span[1] >= b for a, b in held):
            held.append((span[1], span[2]))
            out.append(span)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _around(middle: int, width: int) -> int:
    """Start of the window of a width, aligned to half of it, whose inner half holds a place."""
    return max(0, (middle - width // 4) // (width // 2) * (width // 2))


def _windows(text: str) -> list[tuple[int, int]]:
    """Starts and widths of all windows that hold a mark, and of wide ones around "at" signs."""
    out: dict[tuple[int, int], None] = {}
    for m in _MARK.finditer(text):
        k = m.start() // STEP
        out[max(0, k - 1) * STEP, WINDOW] = out[k * STEP, WINDOW] = None
        if not m[0].isdigit():
            out[max(0, m.start() - WINDOW), 2 * WINDOW] = None
    return list(out)


def _decoded(texts: list[str], todo: list[tuple[int, int, int]], tagger: Tagger, cells: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Tag paths of windows (text, start, width), those of one width together."""
    for width in sorted({w for *_, w in todo}):
        own, rows = [x for x in todo if x[2] == width], max(1, cells // width)
        for at in range(0, len(own), rows):
            part = own[at : at + rows]
            ids = np.zeros((len(part), width), np.int64)
            for r, (k, s, _) in enumerate(part):
                code = encode(texts[k][s : s + width])
                ids[r, : len(code)] = code
            yield from ((*x, path) for x, path in zip(part, tagger.decode(ids)))


def find(texts: list[str], tagger: Tagger, rows: int = 512) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; windows of many texts are decoded together."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[int, Span]]] = [[] for _ in texts]
    todo = [(k, *x) for k, t in enumerate(texts) for x in _windows(t)]
    while todo:
        wider: dict[tuple[int, int, int], None] = {}
        for k, s, width, path in _decoded(texts, todo, tagger, rows * WINDOW):
            if not path.any():
                continue
            for kind, a, b in spans_of(path):
                a, b = a + s, min(b + s, len(texts[k]))
                if (s and a <= s) or b >= s + width < len(texts[k]):
                    wider[k, _around((a + b) // 2, 2 * width), 2 * width] = None
                    continue
                value = texts[k][a:b]
                lost = len(value) - len(value.lstrip())
                a, b = a + lost, a + len(value.rstrip())
                if b > a and _plausible(kind, texts[k][a:b]):
                    left = a - s if s else width
                    right = s + width - b if s + width < len(texts[k]) else width
                    found[k].append((min(left, right), (kind, a, b)))
        todo = list(wider)
    for k in range(len(texts)):
        yield base[k], reconcile(found[k], base[k])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are one, under the first's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"


def detect(docs: DataFrame, tagger: Tagger | None = None, with_text: bool = True) -> DataFrame:
    """``id``, base counts and digest, all spans and the masked text (null without ``with_text``) of ``docs(id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p if tagger else weights(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                rows = []
                for text, (base, every) in zip(texts, find(texts, own)):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), masked(text, every) if with_text else None))
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, {SCHEMA}")


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked; every other column as it is, null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p if tagger else weights(docs.sparkSession))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(place).to_pylist()
                found = find([x or "" for x in texts], own)
                new = [None if x is None else masked(x, every) for x, (_, every) in zip(texts, found)]
                cols = [pa.array(new, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

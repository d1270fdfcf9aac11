"""Personal data by fixed rules and a character-level bidirectional LSTM with CRF.

The rules give the base spans. From them, over a bounded sample of documents, the
network is trained in numpy: labelled spans, beside copies of them written in other
ways (spaced or bracketed separators, numbers without the plus sign), in their text.
Every stretch of text near a digit, an at sign or a bracketed "at" is cut into
overlapping windows; other text cannot hold a span of these kinds. Windows are
decoded by Viterbi, and each character takes its tag from the window that holds it
most inside, so that spans come out once for the whole text. Decoded spans that touch
no base span and have the shape of their kind are added. One pass, no shuffle.
"""

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import bounded_sample, releasing, small_batches

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents are used to train the network.
FIT_ROWS = 1_500
FIT_WINDOWS = 1_600
WINDOW, MARGIN = 96, 32

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]+|[(\[] ?at ?[)\]]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, in the order of kind and start; linear in the text."""
    spans, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                spans.append((0, start, last))
    if _DIGITS.search(text):
        spans += [(1, *m.span()) for m in _IP.finditer(text) if small_parts(m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                spans.append((2, *m.span()))
        if "+" in text:
            spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return spans


# Characters and tags: 0 pads; tag 0 is outside, 1 + 2k begins and 2 + 2k continues kind k.

SYMBOLS, TAGS = 100, 1 + 2 * len(KINDS)


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 30, np.where(points < 32, 97, 98))


def forbidden() -> np.ndarray:
    """True where a tag can't follow another: a kind is continued only after itself."""
    out = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = True
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, one LSTM in each direction, linear emissions, CRF transitions."""

    def __init__(self, hidden: int = 20, width: int = 10, seed: int = 9):
        rng = np.random.default_rng(seed)
        u = lambda *shape, scale=0.2: rng.uniform(-scale, scale, shape).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": u(SYMBOLS, width, scale=0.5), "wo": u(2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32), "tr": u(TAGS, TAGS, scale=0.05)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p |= {f"wx{d}": u(width, 4 * hidden), f"wh{d}": u(hidden, 4 * hidden), f"b{d}": bias}
        self.barred = forbidden()

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states over time of inputs (time, batch, width)."""
        h = self.hidden
        into = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        state, cell, steps, out = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), [], np.empty((*x.shape[:2], h), np.float32)
        for t in range(len(x)):
            g = into[t] + state @ self.p[f"wh{d}"]
            gates, new = sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, came = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            steps.append((i, f, o, new, before, squashed, came))
        return out, steps

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, batch, tag) of codes (batch, time)."""
        x = self.p["emb"][codes.T]
        ahead, steps_f = self.run(x, "f")
        back, steps_b = self.run(x[::-1], "b")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.p["wo"] + self.p["bo"], (x, both, steps_f, steps_b)

    def transitions(self) -> np.ndarray:
        return np.where(self.barred, np.float32(-1e4), self.p["tr"])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags (batch, time)."""
        e, tr = self.emissions(codes)[0], self.transitions()
        score, back = e[0], []
        for t in range(1, len(e)):
            paths = score[:, :, None] + tr
            back.append(paths.argmax(1))
            score = np.take_along_axis(paths, back[-1][:, None, :], 1)[:, 0] + e[t]
        tags = [score.argmax(1)]
        for b in reversed(back):
            tags.append(np.take_along_axis(b, tags[-1][:, None], 1)[:, 0])
        return np.array(tags[::-1]).T

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags (batch, time) and its gradients."""
        e, (x, both, steps_f, steps_b) = self.emissions(codes)
        tr, n, steps = self.transitions(), codes.shape[0], len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = log_sum(alpha[-1], 1)
        rows, y = np.arange(n), tags.T
        gold = sum(e[t][rows, y[t]] for t in range(steps)) + sum(tr[y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - whole[None, :, None])
        dtr = np.zeros_like(tr)
        for t in range(1, steps):
            dtr += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t] - whole[:, None])[:, None, :]).sum(0)
            np.add.at(dtr, (y[t - 1], y[t]), -1)
        for t in range(steps):
            de[t][rows, y[t]] -= 1
        de /= n
        grads = {"tr": np.where(self.barred, 0, dtr / n), "bo": de.sum((0, 1)), "wo": np.tensordot(both, de, ([0, 1], [0, 1]))}
        dboth = de @ self.p["wo"].T
        dx = np.zeros_like(x)
        h = self.hidden
        for d, steps_d, dout, inputs in (("f", steps_f, dboth[:, :, :h], x), ("b", steps_b, dboth[::-1, :, h:], x[::-1])):
            dg = np.empty((steps, n, 4 * h), np.float32)
            dstate, dcell, dwh = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros_like(self.p[f"wh{d}"])
            for t in range(steps - 1, -1, -1):
                i, f, o, new, before, squashed, came = steps_d[t]
                dh = dout[t] + dstate
                dc = dcell + dh * o * (1 - squashed * squashed)
                dg[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                dcell = dc * f
                dstate = dg[t] @ self.p[f"wh{d}"].T
                dwh += came.T @ dg[t]
            grads |= {f"wh{d}": dwh, f"b{d}": dg.sum((0, 1)), f"wx{d}": np.tensordot(inputs, dg, ([0, 1], [0, 1]))}
            back = dg @ self.p[f"wx{d}"].T
            dx += back if d == "f" else back[::-1]
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], codes.T, dx)
        return float((whole - gold).mean()), grads

    def train(self, codes: np.ndarray, tags: np.ndarray, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 9) -> float:
        """Adam over shuffled batches; the mean loss of the last round."""
        rng, moments, t, loss = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0, 0.0
        for epoch in range(rounds):
            order, losses = rng.permutation(len(codes)), []
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                loss, grads = self.gradients(codes[pick], tags[pick])
                losses.append(loss)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                t += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (size + 1e-9))
                    m = moments[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    step = rate * 0.5 ** (epoch / 4) * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss


# Windows of a text, and spans from their tags.


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within `MARGIN` of a trigger."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(begin: int, end: int) -> list[int]:
    """Starts of half-overlapping windows over a stretch."""
    return list(range(begin, max(begin + 1, end - WINDOW // 2), WINDOW // 2))


def cut(codes: np.ndarray, start: int) -> np.ndarray:
    piece = codes[start : start + WINDOW]
    return np.pad(piece, (0, WINDOW - len(piece)))


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Tags of a whole text; where spans meet, the earlier kind stays."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    out, open_ = [], None
    for i, tag in enumerate([*tags.tolist(), 0]):
        kind = (tag - 1) // 2 if tag else None
        if open_ and (kind != open_[0] or tag % 2):
            out.append((open_[0], open_[1] + offset, i + offset))
            open_ = None
        if kind is not None and not open_:
            open_ = (kind, i)
    return out


def shaped(kind: int, text: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    numbers = _DIGITS.findall(text)
    digits = "".join(numbers)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[\w-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]+)+", text, re.IGNORECASE))
    if kind == 1:
        return len(numbers) == 4 and bool(re.fullmatch(r"[0-9]+(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]+){3}", text)) and small_parts(numbers)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", text))
    return 8 <= len(digits) <= 15 and len(numbers) >= 3 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger, at_once: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds beside the base spans of each text."""
    jobs, codes, kept = [], {}, []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        for a, b in stretches(text):
            codes.setdefault(i, coded(text))
            jobs += [(i, a, b, s) for s in windows(a, b)]
    for k in range(0, len(jobs), at_once):
        kept += list(tagger.decode(np.stack([cut(codes[i], s) for i, _, _, s in jobs[k : k + at_once]])))
    k = 0
    while k < len(jobs):
        i, a, b, _ = jobs[k]
        tags = np.zeros(b - a, np.int64)
        while k < len(jobs) and jobs[k][:3] == (i, a, b):
            # All but the first window leave their first quarter to the one before.
            begin = jobs[k][3] + (WINDOW // 4 if jobs[k][3] > a else 0)
            end = min(b, jobs[k][3] + WINDOW)
            if begin < end:
                tags[begin - a : end - a] = kept[k][begin - jobs[k][3] : end - jobs[k][3]]
            k += 1
        for kind, s, e in spans_of(tags, a):
            clear = all(e <= x or y <= s for _, x, y in base[i])
            if clear and shaped(kind, texts[i][s:e]):
                out[i].append((kind, s, e))
    return out


# Training from labelled spans.


def rewritten(kind: int, found: str, rng: np.random.Generator) -> str:
    """The same datum written in another way."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        name, domain = found.split("@", 1)
        return name + pick(" @ ", "(at)", " (at) ", "[at]", " [at] ") + domain.replace(".", pick(".", "[dot]", " (dot) "))
    if kind == 1:
        return found.replace(".", pick(" . ", "[.]", "(.)"))
    if kind == 2:
        digits = digits_of(found)
        return pick(".", "/", "  ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    numbers = _DIGITS.findall(found)
    return pick(" ", "-", ".", "/").join(pick(numbers, numbers[1:] if len("".join(numbers[1:])) >= 8 else numbers))


def examples(texts: list[str], most: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows: around triggers as they are, and with spans rewritten."""
    rng, codes, tags = np.random.default_rng(seed), [], []
    for text in texts:
        if len(codes) >= most:
            break
        spans = base_spans(text)
        variants = [(text, spans)]
        if spans:
            kind, a, b = spans[rng.integers(len(spans))]
            new = rewritten(kind, text[a:b], rng)
            left, right = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
            around = [s for s in base_spans(left + " " * len(new) + right) if s[2] <= len(left) or s[1] >= len(left) + len(new)]
            variants.append((left + new + right, [(kind, len(left), len(left) + len(new)), *around]))
        for body, known in variants:
            all_codes, all_tags = coded(body), tags_of(known, len(body))
            for a, b in stretches(body)[:6]:
                shift = int(rng.integers(0, WINDOW // 4))
                start = max(0, a - shift)
                codes.append(cut(all_codes, start))
                tags.append(cut(all_tags, start))
    if not codes:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack(codes[:most]), np.stack(tags[:most])


def fit(texts: list[str], most: int = FIT_WINDOWS) -> Tagger:
    tagger = Tagger()
    codes, tags = examples(texts, most)
    if (tags > 0).any():
        tagger.train(codes, tags)
    else:
        tagger.p["bo"][1:] = -1e3  # nothing to learn from: everything is outside
    return tagger


def train(docs: DataFrame, rows: int = FIT_ROWS, text: str = "text") -> Tagger:
    """The network, trained in one task on a bounded sample of the documents that hold a digit or an at sign."""
    known = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((x for batch in batches for x in batch.column(0).to_pylist()), key=lambda x: hash_of(x))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(texts).p)]})

    found = bounded_sample(known, [F.col("text")], rows).repartition(1).mapInArrow(releasing(learn), "model binary").collect()
    if not found:
        return fit([])
    tagger = Tagger()
    tagger.p = pickle.loads(found[0]["model"])
    return tagger


def hash_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def find(docs: DataFrame, tagger: Tagger, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows, the columns `carry` (all if None), and `spans`: kind, start, end (code points), base.

    Spans come in the order of kind and start. A null or empty text has none. Equal
    texts have equal spans. A column `spans` of the input is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"])
    carry = docs.columns if carry is None else carry
    empty = F.expr("cast(null as array<struct<kind:string,start:bigint,end:bigint,base:boolean>>)").alias("spans")
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    weights = docs.sparkSession.sparkContext.broadcast(tagger.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = weights.value
        for batch in small_batches(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": was} for k, s, e, was in sorted([(*x, True) for x in a] + [(*x, False) for x in b])]
                for a, b in zip(base, more)
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(spans, kind_of)], names=[*carry, "spans"])

    return docs.mapInArrow(releasing(run), docs.select(*[F.col(f"`{c}`") for c in carry], empty).schema)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with every stretch of overlapping spans replaced by the kind that begins it."""
    pieces, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            pieces += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*pieces, text[at:]])


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `find` with personal data replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; a null text stays null."""
    kept = found.drop("spans")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redacted(t, s) for t, s in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return found.mapInArrow(releasing(run), kept.schema)

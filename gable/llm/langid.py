"""Language identification by interpolated Kneser-Ney models of characters.

For each learned language, n-grams of up to five characters are counted over a bounded
sample of its documents, and interpolated Kneser-Ney probabilities of all orders are
kept in sorted hash arrays. A text is scored under every language; the lowest
cross-entropy per character wins. A logistic calibration, fitted on documents and
short pieces outside the counted ones, turns the lead into a probability; a text whose
cross-entropy is above what the language's own texts reach, or whose lead is too
small, is not accepted. Scoring is one pass without a shuffle.
"""

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gable.llm.common import by_value, ranges, row_sums, small_batches
from gable.session import staged

#: At most so many documents of each language are used to fit the models.
ROWS_PER_LANGUAGE = 1_500
ORDER = 5
#: Unseen characters are taken from an alphabet of this size.
ALPHABET = 2_000
UNDETERMINED = "und"
_SALTS = np.random.default_rng(1).integers(1, 1 << 63, 3 * ORDER + 3, dtype=np.uint64) | np.uint64(1)


def letters_table() -> np.ndarray:
    """Which code points of the basic plane are letters or marks."""
    return np.array([chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(1 << 16)])


class Texts:
    """Lower-case letters of texts, other characters as one blank, four blanks before each text."""

    def __init__(self, texts: list[str], letter: np.ndarray):
        lowered = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in lowered], np.int64)
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        known = letter[np.minimum(points, (1 << 16) - 1)]
        far = points >= 1 << 16
        if far.any():
            known[far] = [chr(c).isalpha() for c in points[far].tolist()]
        points = np.where(known, points, 32)
        ends = np.cumsum(sizes)
        first = np.zeros(len(points) + 1, bool)
        first[ends - sizes] = True
        # A blank is kept only behind a letter of the same text.
        keep = known | (np.r_[False, known[:-1]] & ~first[:-1])[: len(points)]
        total = np.r_[0, np.cumsum(keep)]
        self.sizes = total[ends] - total[ends - sizes]
        letters = np.r_[0, np.cumsum(known)]
        self.lettered = letters[ends] > letters[ends - sizes]
        starts = np.cumsum(self.sizes + ORDER - 1) - self.sizes
        self.padded = np.full(int((self.sizes + ORDER - 1).sum()), 32, np.int64)
        self.at = ranges(starts, self.sizes)
        self.padded[self.at] = points[keep]

    def grams(self) -> np.ndarray:
        """The n-gram that ends at each character, oldest character first."""
        return np.stack([self.padded[self.at - k] for k in range(ORDER - 1, -1, -1)], axis=1)


def hashed(grams: np.ndarray, order: int, salt: int) -> np.ndarray:
    """A 64-bit hash of the last `order` characters of each row."""
    out = np.full(len(grams), _SALTS[3 * order + salt - 1], np.uint64)
    for k in range(order):
        out = (out ^ grams[:, grams.shape[1] - 1 - k].astype(np.uint64)) * _SALTS[k]
        out ^= out >> np.uint64(29)
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a row of each, and the number of each row's key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From distinct n-grams and counts, for each order: n-gram hashes, log probabilities, context hashes, log weights."""
    levels = []
    for order in range(ORDER, 0, -1):
        keys, row, number = grouped(hashed(grams, order, 0))
        if order == ORDER:
            level = np.bincount(number, counts, len(keys))
        else:  # how many characters stand before it
            level = np.bincount(number, minlength=len(keys)).astype(float)
        grams = grams[row]
        levels.append((order, keys, grams, level))
    out, below = [], None
    for order, keys, grams, count in reversed(levels):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, _, of = grouped(hashed(grams[:, :-1], order - 1, 1))
        total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        weight = discount * kinds / total
        if below is None:
            lower = np.full(len(keys), 1 / ALPHABET)
        else:
            lower = below[1][np.searchsorted(below[0], hashed(grams, order - 1, 0))]
        p = (count - discount) / total[of] + weight[of] * lower
        below = (keys, p)
        out.append((keys, np.log(p).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
    return out


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], np.float32(0))


def log_probabilities(model: list[tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
    """Of the last character of each n-gram, given those before it."""
    out, left = np.zeros(len(grams), np.float32), np.arange(len(grams))
    for order in range(ORDER, 0, -1):
        keys, logp, contexts, weights = model[order - 1]
        rest = grams[left]
        found, value = looked_up(keys, logp, hashed(rest, order, 0))
        _, weight = looked_up(contexts, weights, hashed(rest[:, :-1], order - 1, 1))
        out[left] += np.where(found, value, weight)
        left = left[~found]
        if not len(left):
            return out
    out[left] -= np.float32(np.log(ALPHABET))
    return out


def cross_entropies(models: list[list[tuple[np.ndarray, ...]]], texts: Texts) -> np.ndarray:
    """Nats per character of each text under each model, and last under an even choice of all characters."""
    grams = texts.grams()
    keys, row, number = grouped(hashed(grams, ORDER, 0))
    few, n = grams[row], np.maximum(texts.sizes, 1)
    columns = [-row_sums(log_probabilities(m, few)[number], texts.sizes) / n for m in models]
    return np.column_stack([*columns, np.full(len(n), np.log(ALPHABET))])


def leads(entropies: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best model, its cross-entropy, and what the calibration looks at: lead a character and over the whole."""
    best = entropies[:, :-1].argmin(1)
    ordered = np.sort(entropies, axis=1)
    lead = np.where(entropies.argmin(1) == best, ordered[:, 1] - ordered[:, 0], 0.0)
    return best, entropies[np.arange(len(best)), best], np.column_stack([lead, np.log1p(lead * sizes)])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty * w), -3, 3)
    return w


class Model:
    def __init__(self, languages: list[str], models: list):
        self.languages, self.models = languages, models
        self.weights, self.ceilings = np.array([0.0, 2.0, -2.0]), np.full(len(languages), 0.9 * np.log(ALPHABET))

    def judge(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, cross-entropy, calibrated probability, accepted."""
        best, entropy, x = leads(cross_entropies(self.models, texts), texts.sizes)
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))
        return best, entropy, p, texts.lettered & (entropy <= self.ceilings[best]) & (p >= 0.5)

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        """Fit the probability on texts and on pieces of them, and the ceilings on the texts."""
        letter, xs, ys = letters_table(), [], []
        truth = np.array([self.languages.index(x) for x in languages])
        for piece in (None, 10, 25, 60):
            cut = [t if piece is None else t[len(t) // 3 :][:piece] for t in texts]
            looked = Texts(cut, letter)
            best, entropy, x = leads(cross_entropies(self.models, looked), looked.sizes)
            use = looked.lettered
            xs.append(x[use])
            ys.append((best == truth)[use])
            if piece is None:
                for i in range(len(self.languages)):
                    own = entropy[use & (best == truth) & (truth == i)]
                    if len(own) >= 20:
                        self.ceilings[i] = 1.1 * np.quantile(own, 0.995)
        if sum(map(len, ys)):
            self.weights = logistic(np.concatenate(xs), np.concatenate(ys).astype(float))


def train(docs: DataFrame, learnable: Column, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Models of all values of `lang` among the documents that are `learnable`.

    Documents without text or language teach nothing. Without any, the model knows no
    language and every text is undetermined.
    """
    learn = docs.where(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [])
    key = F.xxhash64(F.lit(11), "text")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.2 * rows + 200) / n))])
    few = learn.where(F.pmod(key, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(key, "text"))
    sample = staged(few.withColumn("_at", place).where(F.col("_at") <= rows).withColumn("_check", F.col("_at") % 6 == 0).drop("_at"), "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters_table()
        for batch in small_batches(batches, "text", 2 << 20):
            texts = np.array(batch.column("text").to_pylist(), object)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                grams = Texts(list(texts[langs == lang]), letter).grams()
                if not len(grams):
                    continue
                keys, row, number = grouped(hashed(grams, ORDER, 0))
                body = grams[row].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                parts = [body[i : i + ORDER] for i in range(0, len(body), ORDER)]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(parts), "gram": parts, "n": np.bincount(number)})

    def fit(rows: pa.Table) -> pa.Table:
        body = "".join(rows.column("gram").to_pylist())
        grams = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER).astype(np.int64)
        model = kneser_ney(grams, rows.column("n").to_numpy().astype(float))
        return pa.table({"lang": rows.column("lang")[:1], "model": [pickle.dumps(model)]})

    grams = sample.where(~F.col("_check")).mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    fitted = grams.groupBy("lang").applyInArrow(fit, "lang string, model binary").orderBy("lang").collect()
    model = Model([r["lang"] for r in fitted], [pickle.loads(r["model"]) for r in fitted])
    check = sample.where(F.col("_check") & F.col("lang").isin(model.languages or [""])).orderBy(key).collect() if fitted else []
    if check:
        model.calibrate([r["text"] for r in check], [r["lang"] for r in check])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows, the columns `carry` (all if None), `lang_pred`, `score`, `cross_entropy`, `accepted`.

    `lang_pred` is the best learned language, also where it is not accepted; it is
    "und", with score 0, where the text is null or has no letter or no language is
    known. Only the text counts: equal texts have equal results. Columns of the input
    called like the new ones are replaced.
    """
    new = ("lang_pred", "score", "cross_entropy", "accepted")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    carry = docs.columns if carry is None else carry
    more = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("accepted")]
    sent = by_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letter = sent(), letters_table()
        for batch in small_batches(batches, text, 2 << 20):
            texts = Texts([t or "" for t in batch.column(text).to_pylist()], letter)
            if known.languages:
                best, entropy, p, accepted = known.judge(texts)
                names = [known.languages[b] if ok else UNDETERMINED for b, ok in zip(best, texts.lettered)]
            else:
                entropy, p, accepted, names = *np.zeros((2, len(texts.sizes))), np.zeros(len(texts.sizes), bool), [UNDETERMINED] * len(texts.sizes)
            found = [pa.array(names), pa.array(np.where(texts.lettered, p, 0.0)), pa.array(np.where(texts.lettered, entropy, 0.0)), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *found], names=[*carry, *new])

    return docs.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in carry], *more).schema)

"""Language ID by interpolated Kneser-Ney models of characters, one for each language.

The models' probabilities lie in sorted arrays of n-gram hashes with a column for each language, so one search serves
all languages. The language of the lowest cross-entropy per character wins; a text whose cross-entropy is far above
what calibration texts of that language show is rejected. What is tolerated shrinks with length only as far as long
texts of one language differ by topic and vocabulary.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import documents, portions, set_aside, with_columns

#: Characters of an n-gram.
ORDER = 4
#: The models learn from about so many texts of a language, and rejection is calibrated on about so many others. Both
#: are chosen by a hash of doc_id from all of them, and bound what comes to the driver.
TRAINING_TEXTS = 3000
CALIBRATION_TEXTS = 1000
#: What fraction of calibration texts lies below the limit, and how far beyond it texts are still accepted.
#: Characters whose n-grams are looked up together.
PIECE = 1 << 18
#: Bytes of texts that are looked at together.
TEXT = 400_000
RESULTS = ["lang_pred", "lang_score", "cross_entropy", "rejected"]
QUANTILE, SLACK = 0.999, 2.0
UNKNOWN = "und"
_FACTOR, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)
_POWERS = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(ORDER)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with one blank for each run of anything else, ORDER - 1 zeros before each text; the text of each."""
    pad = ORDER - 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths)
    blank = codes == 32
    again = np.zeros(len(codes), bool)
    again[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    codes, owner = codes[~again], owner[~again]
    sizes = np.bincount(owner, minlength=len(texts))
    out, whose = np.zeros(len(codes) + pad * len(texts), np.uint32), np.repeat(np.arange(len(texts)), sizes + pad)
    out[np.arange(len(codes)) + pad * (owner + 1)] = codes
    return out, whose


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 1 .. ORDER the hash of the k characters that end at each place; only places with so many before count."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _FACTOR + _ADD
    mixed ^= mixed >> np.uint64(29)
    out = [mixed.copy()]
    for k in range(1, ORDER):
        h = out[-1].copy()
        h[k:] += mixed[:-k] * _POWERS[k] if k < len(mixed) else mixed[:0]
        out.append(h)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: the n-grams of the highest order, counted where texts are read and then added up."""

    def count(batches):
        for batch in portions(batches, most=TEXT):
            part = batch.to_pandas().dropna(subset=["lang", "text"])
            for lang, texts in part.groupby("lang").text:
                codes, _ = normalised(list(texts))
                windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                windows = windows[windows[:, -1] > 0]
                grams, n = np.unique(windows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "gram": [g.tobytes() for g in grams.astype("<u4")], "n": n.astype(np.int64)})

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """Kneser-Ney models of all languages: for each order sorted hashes and log probabilities, and back-off weights of contexts."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: for each language the n-grams of the highest order as rows of code points, and their counts."""
        self.langs, self.limits = langs, {}
        count: list[list[dict]] = []
        for lang in langs:
            rows, n = grams[lang]
            orders = [dict(zip(map(tuple, rows.tolist()), n.tolist()))]
            for _ in range(ORDER - 1):  # below the highest order, what counts is how many characters a gram follows
                lower: dict[tuple, int] = {}
                for g in orders[-1]:
                    lower[g[1:]] = lower.get(g[1:], 0) + 1
                orders.append(lower)
            count.append(orders[::-1])
        letters = {g[-1] for c in count for g in c[0]}
        uniform = 1 / (len(letters) + 1)
        self.floor = np.full(len(langs), np.log(uniform), np.float32)
        self.keys, self.logs, self.contexts, self.weights = [], [], [], []
        below: list[dict] = [{} for _ in langs]
        for k in range(1, ORDER + 1):
            union = sorted({g for c in count for g in c[k - 1]})
            probability = np.zeros((len(union), len(langs)))
            known = sorted({g[:-1] for g in union})
            weight = np.ones((len(known), len(langs)))
            place = {x: i for i, x in enumerate(known)}
            tables = []
            for j, orders in enumerate(count):
                table, total, kinds, ones, twos = orders[k - 1], {}, {}, 0, 0
                for g, n in table.items():
                    total[g[:-1]] = total.get(g[:-1], 0) + n
                    kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
                    ones, twos = ones + (n == 1), twos + (n == 2)
                less = ones / (ones + 2 * twos) if ones and twos else 0.5
                rest = {x: less * kinds[x] / total[x] for x in total}
                for x, v in rest.items():
                    weight[place[x], j] = v
                lower = below[j]
                found = {}
                for i, g in enumerate(union):
                    under = uniform if k == 1 else lower.get(g[1:], uniform)
                    x = g[:-1]
                    p = (max(table.get(g, 0) - less, 0) / total[x] + rest[x] * under) if x in total else under
                    probability[i, j] = found[g] = p
                tables.append(found)
            below = tables
            self._keep(union, np.log(probability), self.keys, self.logs)
            self._keep(known, np.log(weight), self.contexts, self.weights)

    @staticmethod
    def _keep(grams: list[tuple], values: np.ndarray, keys: list, logs: list) -> None:
        if not grams or not grams[0]:  # the empty context
            keys.append(np.zeros(0, np.uint64))
            logs.append(values.astype(np.float32))
            return
        k = len(grams[0])
        codes = np.array(grams, np.uint32)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _FACTOR + _ADD
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(len(grams), np.uint64)
        for j in range(k):
            h += mixed[:, k - 1 - j] * _POWERS[j]
        order = np.argsort(h)
        keys.append(h[order])
        logs.append(values[order].astype(np.float32))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character for each text and language, the number of characters, and that of letters."""
        codes, owner = normalised(texts)
        sums, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for start in range(0, len(codes), PIECE):  # a piece at a time, with the characters before it as context
            before = min(start, ORDER - 1)
            piece, whose = codes[start - before : start + PIECE], owner[start - before : start + PIECE]
            places = before + np.nonzero(piece[before:] > 0)[0]
            total, whose = self._logs(piece, places), whose[places]
            n += np.bincount(whose, minlength=len(texts))
            letters += np.bincount(whose[piece[places] != 32], minlength=len(texts))
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(whose, total[:, j], len(texts))
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _logs(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The log probability of the character at each place in each language."""
        hashes = gram_hashes(codes)
        total = np.zeros((len(places), len(self.langs)), np.float32)
        left = np.arange(len(places))
        for k in range(ORDER, 0, -1):
            at, ok = self._find(self.keys[k - 1], hashes[k - 1][places[left]])
            total[left[ok]] += self.logs[k - 1][at[ok]]
            left = left[~ok]
            if k > 1:  # the context's weight, and one order less
                at, ok = self._find(self.contexts[k - 1], hashes[k - 2][places[left] - 1])
                total[left[ok]] += self.weights[k - 1][at[ok]]
            elif len(self.weights[0]):
                total[left] += self.weights[0][0] + self.floor
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, cross-entropy per character and whether the text is rejected."""
        loss, n, letters = self.losses([t or "" for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
        best = loss.argmin(1)
        least = loss.min(1)
        share = np.exp(-n[:, None] * (loss - least[:, None]))  # the chance of each language, were all alike before
        share = share[np.arange(len(best)), best] / share.sum(1)
        none = letters == 0
        bound = np.array([self.limits.get(x, (0.0, np.inf, 0.0)) for x in self.langs])[best]
        odd = least - bound[:, 0] > np.maximum(bound[:, 1] / np.sqrt(np.maximum(n, 1)), bound[:, 2])
        langs = [UNKNOWN if z else self.langs[b] for b, z in zip(best.tolist(), none.tolist())]
        return langs, np.where(none, 0.0, share).tolist(), np.where(none, 0.0, least).tolist(), (none | odd).tolist()


def _remainder(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4, F.lit(0))


def learn(docs: DataFrame, training: int = TRAINING_TEXTS, calibration: int = CALIBRATION_TEXTS) -> Models:
    """The models of all languages that docs (doc_id, text, lang) label. Rows of remainder 2 are never read.

    Rows of remainder 3 calibrate rejection, the others train. The hash of doc_id that chooses a row does not depend
    on its text; of a language with no more rows than the bound, all count.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (_remainder() != 2))
    sizes = labelled.groupBy("lang").agg(F.count_if(_remainder() != 3).alias("train"), F.count_if(_remainder() == 3).alias("test")).collect()
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return Models([], {})
    share = {r.lang: (training / max(r.train, 1), calibration / max(r.test, 1)) for r in sizes}
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    limit = lambda i: F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang][i])]), F.col("lang"))
    train = labelled.where((_remainder() != 3) & (chance < limit(0)))
    rows = count_grams(train).toPandas()
    grams = {}
    for lang in langs:
        part = rows[rows.lang == lang]
        grams[lang] = np.frombuffer(b"".join(map(bytes, part.gram)), "<u4").reshape(-1, ORDER), part.n.to_numpy()
    models = Models(langs, grams)
    test = labelled.where((_remainder() == 3) & (chance < limit(1))).select("lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for batch in portions(batches, most=TEXT):
            part = batch.to_pandas().dropna()
            if len(part):
                loss, n, letters = shared.value.losses(list(part.text))
                own = loss[np.arange(len(part)), [shared.value.langs.index(x) for x in part.lang]]
                yield pa.RecordBatch.from_pydict({"lang": part.lang.tolist(), "loss": own.astype(np.float64), "n": n.astype(np.int64), "letters": letters.astype(np.int64)})

    seen = test.mapInArrow(measure, "lang string, loss double, n long, letters long").where("letters > 0").toPandas()
    for lang, part in seen.groupby("lang"):
        middle = float(np.average(part.loss, weights=part.n))
        spread = (part.loss - middle) * np.sqrt(part.n)
        long = part.loss[part.n >= part.n.median()] - middle
        models.limits[lang] = middle, SLACK * float(max(np.quantile(spread, QUANTILE), 1.0)), SLACK * float(max(np.quantile(long, QUANTILE), 0.0))
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), cross_entropy (nats a character) and rejected, from `text` alone.

    Null texts and texts without a letter are `und`, of score 0, and rejected. Ties go to the first language by name.
    Repeated rows are judged alike, whole texts of any length are read, an empty table gives an empty result. Further
    columns pass through; those that have a result's name are given back as `<name>_in`.
    """
    work, back = set_aside(docs, ["text"], RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in portions(batches, most=TEXT):
            langs, score, loss, odd = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield with_columns(batch, lang_pred=pa.array(langs, pa.string()), lang_score=pa.array(score, pa.float64()), cross_entropy=pa.array(loss, pa.float64()), rejected=pa.array(odd, pa.bool_()))

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return back(work.mapInArrow(run, T.StructType([*work.schema.fields, *more])))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (_remainder() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}

"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is its letters, lower-cased, with one space for each run of other characters. Each model interpolates the orders 1 to 4;
a text gets the language of the lowest cross-entropy per character. A text is accepted by models that haven't seen it: the corpus
is halved by a hash of the text, each half is judged by the models of the other, and what these give the texts whose label is the
language found sets the limits, by language and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime

ORDER = 4
_BITS = 16
_MASK = (1 << _BITS) - 1
#: N-grams of all languages that are held in sorted arrays and sent to all tasks, at most (fewer with more than 4 languages, as
#: each takes a column). More stay a table, of which a block of texts fetches the rows it needs; the results are the same.
GRAMS = 1_000_000
#: Characters of a block times its languages and 4.
BLOCK_CELLS = 16_000_000
UNKNOWN = "und"
#: A language rejects what is more than ``WIDE`` times the distance from median to upper quartile, this at least ``SPREAD``, above
#: the median bits of its texts of about that length (within a power of two). Up to a quarter of junk among its texts shifts these
#: little. Lengths with fewer than ``LEAST_CLASS`` texts get theirs from all lengths, languages with fewer than ``LEAST`` none.
WIDE, SPREAD, LEAST_CLASS, LEAST = 8.0, 0.05, 50, 20
CLASSES = 32
_BIN = 0.02
_table: list[np.ndarray] = []


def _low(k: int) -> int:
    """The mask of an n-gram's last ``k`` codes; four fill a long."""
    return (1 << _BITS * k) - 1 if k * _BITS < 64 else -1


def _codes(text: str) -> np.ndarray:
    """16-bit codes of the letters, lower-cased, 0 for each run of other characters, also before and after.

    Letters below U+10000 are numbered, so none shares its code; those above, of rare Han characters and dead scripts, share what is left.
    """
    if not _table:
        lower = [ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(65536)]
        near = sorted({c for c in lower if 0 < c < 65536})
        number = {c: k for k, c in enumerate(near, 1)}
        _table.append(np.array([number.get(c, 0) for c in lower], np.int64))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = points >= 65536
    codes = _table[0][np.where(far, 0, points)]
    if far.any():
        last = int(_table[0].max())
        codes[far] = [last + 1 + ord(chr(p).lower()[0]) % (_MASK - last) if chr(p).isalpha() else 0 for p in points[far]]
    codes = np.concatenate(([0], codes, [0]))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def _grams(codes: np.ndarray) -> np.ndarray:
    """For each code after the first, it and the codes before it, packed; before the start all are 0."""
    padded = np.concatenate((np.zeros(ORDER - 2, np.int64), codes))
    n = len(codes) - 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = (out << _BITS) | padded[k : k + n]
    return out


def _half(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    size: dict[tuple[str, int], int] = {}

    def fold(lang: tuple[str, int]) -> None:
        key, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        size[lang] = 0
        sums[lang] = _merged([sums[lang][0], key], [sums[lang][1], n]) if lang in sums else (key, n)

    def rows(lang: tuple[str, int]) -> pa.RecordBatch:
        key, n = sums.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang[0]] * len(key), pa.string()), pa.array([lang[1]] * len(key), pa.int32()), pa.array(key), pa.array(n)], ["lang", "half", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = _grams(_codes(text))
            lang = (lang, _half(text))
            held.setdefault(lang, []).append(grams)
            size[lang] = size.get(lang, 0) + len(grams)
            if size[lang] > 1_000_000:
                fold(lang)
                if sum(len(k) for k, _ in sums.values()) > 4_000_000:
                    yield from [rows(x) for x in [*sums]]
    for lang in [*held]:
        fold(lang)
    yield from [rows(x) for x in [*sums]]


class Model:
    """Kneser-Ney models of all languages side by side: per order sorted n-grams with discounted shares, contexts with back-off weights."""

    #: The models' rows, where there are too many for arrays.
    table: DataFrame | None = None
    #: For the texts of each half, the models of the other.
    halves: list[Model] = []

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        self.limits = np.full((len(self.langs), CLASSES), np.inf)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        per = {}
        for lang, (key, n) in grams.items():
            levels = [(key, n.astype(float))]
            for k in range(ORDER - 1, 0, -1):  # how many different characters stand before a shorter n-gram
                key, n = np.unique(levels[0][0] & _low(k), return_counts=True)
                levels.insert(0, (key, n.astype(float)))
            per[lang] = levels
        letters = np.unique(np.concatenate([per[x][0][0] for x in self.langs])) if self.langs else np.empty(0)
        self.floor = 1 / (len(letters) + 1)
        for k in range(ORDER):
            keys = np.unique(np.concatenate([per[x][k][0] for x in self.langs])) if self.langs else np.empty(0, np.int64)
            contexts = np.unique(keys >> _BITS)
            share = np.zeros((len(keys), len(self.langs)), np.float32)
            weight = np.ones((len(contexts), len(self.langs)), np.float32)
            for j, lang in enumerate(self.langs):
                key, n = per[lang][k]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.3, ones / max(1, ones + 2 * twos)))
                context, at = np.unique(key >> _BITS, return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                share[np.searchsorted(keys, key), j] = (n - discount) / total[at]
                weight[np.searchsorted(contexts, context), j] = discount * kinds / total
            self.orders.append((keys, share, contexts, weight))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 P(last | before) of each n-gram in each language."""
        p = np.full((len(grams), len(self.langs)), self.floor)
        for k, (keys, share, contexts, weight) in enumerate(self.orders):
            part = grams & _low(k + 1)
            for table, values, of in ((contexts, weight, part >> _BITS), (keys, share, part)):
                if not len(table):
                    continue
                at = np.minimum(np.searchsorted(table, of), len(table) - 1)
                seen = table[at] == of
                if table is contexts:
                    p[seen] *= values[at[seen]]
                else:
                    p[seen] += values[at[seen]]
        return -np.log2(p)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character in each language, number of characters; 0 without letters) of each text."""
        grams = [_grams(_codes(t or "")) for t in texts]
        n = np.array([len(g) if (g & _MASK).any() else 0 for g in grams])
        out = np.zeros((len(texts), len(self.langs)))
        if n.any() and self.langs:
            with_letters = np.flatnonzero(n)
            at, distinct = pd.factorize(np.concatenate([grams[i] for i in with_letters]))
            bits = self.bits(distinct)
            start = np.concatenate(([0], np.cumsum(n[with_letters])[:-1]))
            for j in range(len(self.langs)):
                out[with_letters, j] = np.add.reduceat(bits[:, j][at], start) / n[with_letters]
        return out, n


def _slices(texts: list, most: int = 2_000_000) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _class(n: int) -> int:
    return min(int(n).bit_length(), CLASSES) - 1


def _unseen(m: Model, texts: list[str | None]) -> np.ndarray:
    """Bits per character of each text in each language, by the models of the half it isn't in."""
    out, half = np.zeros((len(texts), len(m.langs))), np.array([_half(t or "") for t in texts])
    for k, other in enumerate(m.halves):
        at = np.flatnonzero(half == k)
        if len(at):
            out[at] = other.entropies([texts[i] for i in at])[0]
    return out


def _own(m: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    place = {x: j for j, x in enumerate(m.langs)}
    texts, langs, got = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
    for part in _slices(texts):
        bits = _unseen(m, texts[part])
        for x, row, text in zip(langs[part], bits, texts[part], strict=True):
            codes = _codes(text)
            if codes.any() and x in place and row[place[x]] == row.min():
                got.append((x, _class(len(codes) - 1), int(row[place[x]] / _BIN)))
    return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], ["lang", "class", "bin"])


def _predictions(m: Model, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    langs, scores, bits, fits = [], [], [], []
    for part in _slices(texts):
        h, n = m.entropies(texts[part])
        unseen = _unseen(m, texts[part])
        for row, other, k in zip(h, unseen, n, strict=True):
            if not k or not len(row):
                langs.append(UNKNOWN), scores.append(0.0), bits.append(None), fits.append(False)
                continue
            best = int(np.argmin(row))
            langs.append(m.langs[best])
            scores.append(float(1 / np.exp2(np.clip((row[best] - row) * min(k, 30), -500, 0)).sum()))
            bits.append(float(row[best]))
            fits.append(bool(other[best] <= m.limits[best, _class(k)]))
    return pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(fits, pa.bool_())], ["doc_id", "lang_pred", "score", "bits", "accepted"])


def _middle(bins: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Median and its distance to the upper quartile."""
    order = np.argsort(bins)
    share = np.cumsum(n[order]) / n.sum()
    low, high = ((bins[order][np.argmax(share >= q)] + 0.5) * _BIN for q in (0.5, 0.75))
    return low, max(SPREAD, high - low)


def _limits(classes: np.ndarray, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The limits of one language, by class of length, from the numbers n of its texts by class and bin of bits."""
    out = np.full(CLASSES, np.inf)
    if n.sum() < LEAST:
        return out
    middle, spread = _middle(bins, n)
    order = np.argsort(classes)
    typical = classes[order][np.argmax(np.cumsum(n[order]) >= n.sum() / 2)]
    for c in range(CLASSES):
        of = classes == c
        if n[of].sum() >= LEAST_CLASS:
            low, wide = _middle(bins[of], n[of])
        else:  # a mean over fewer characters strays further
            low, wide = middle, spread * max(1.0, 2.0 ** ((typical - c) / 2))
        out[c] = low + WIDE * wide
    return out


def _table_of(counts: DataFrame, langs: list[str]) -> DataFrame:
    """What ``Model`` computes from ``counts`` (lang, gram, n), as rows (part, key, js, values): an n-gram of k + 1 characters has
    its share in part 2 k, a context of k characters its weight in part 2 k + 1, each for the languages js that have it."""
    number = counts.sparkSession.createDataFrame([(x, j) for j, x in enumerate(langs)], "lang string, j int")
    level = counts.join(F.broadcast(number), "lang").select("j", F.col("gram").alias("key"), F.col("n").cast("double").alias("n"))
    parts: list[DataFrame] = []
    for k in range(ORDER - 1, -1, -1):
        if k < ORDER - 1:  # how many different characters stand before a shorter n-gram
            level = level.groupBy("j", F.col("key").bitwiseAND(F.lit(_low(k + 1)).cast("long")).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        level = _runtime.cut(level.withColumn("context", F.shiftright("key", _BITS)))
        ones, twos = F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), F.sum(F.when(F.col("n") == 2, 1.0).otherwise(0.0))
        discount = level.groupBy("j").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.3), ones / F.greatest(F.lit(1.0), ones + 2 * twos))).alias("discount"))
        context = level.groupBy("j", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(F.broadcast(discount), "j")
        share = level.join(context, ["j", "context"]).select(F.lit(2 * k).alias("part"), "key", "j", ((F.col("n") - F.col("discount")) / F.col("total")).cast("float").alias("value"))
        parts += [share, context.select(F.lit(2 * k + 1).alias("part"), F.col("context").alias("key"), "j", (F.col("discount") * F.col("kinds") / F.col("total")).cast("float").alias("value"))]
        level = level.drop("context")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    of = F.array_sort(F.collect_list(F.struct("j", "value")))
    return _runtime.cut(rows.groupBy("part", "key").agg(of.alias("of")).select("part", "key", F.col("of.j").alias("js"), F.col("of.value").alias("values")))


def _needed(texts: list[str | None]) -> list[tuple[int, np.ndarray]]:
    """(part, distinct keys) that the models look up for ``texts``."""
    seen = np.empty(0, np.int64)
    for part in _slices(texts):
        seen = np.unique(np.concatenate([seen, *(_grams(_codes(t or "")) for t in texts[part])]))
    keys = [np.unique(seen & _low(k + 1)) for k in range(ORDER)]
    return [x for k in range(ORDER) for x in ((2 * k, keys[k]), (2 * k + 1, np.unique(keys[k] >> _BITS)))]


def _part_of(rest: Model, found: pa.Table) -> Model:
    """The models with the rows ``found`` only, those of the halves too."""
    m, *m.halves = (_alone(x, found.filter(pa.compute.equal(found["of"], k))) for k, x in enumerate((rest, *rest.halves)))
    return m


def _bare(model: Model) -> Model:
    """``model`` without its n-grams."""
    m = Model({})
    m.langs, m.limits, m.floor, m.orders, m.halves = model.langs, model.limits, model.floor, [], [_bare(x) for x in model.halves]
    return m


def _alone(rest: Model, found: pa.Table) -> Model:
    m = _bare(rest)
    part, key = found["part"].to_numpy(), found["key"].to_numpy()
    js, values = (pa.concat_arrays(found[x].chunks) if found.num_rows else pa.array([], found.schema.field(x).type) for x in ("js", "values"))
    row = np.repeat(np.arange(len(key)), js.value_lengths().to_numpy())
    js, values = js.flatten().to_numpy(), values.flatten().to_numpy()
    for k in range(ORDER):
        both = []
        for p, other in ((2 * k, 0), (2 * k + 1, 1)):
            at = np.flatnonzero(part == p)
            at = at[np.argsort(key[at])]
            place = np.full(len(key), -1)
            place[at] = np.arange(len(at))
            table = np.full((len(at), len(m.langs)), other, np.float32)
            of = place[row] >= 0
            table[place[row[of]], js[of]] = values[of]
            both += [key[at], table]
        m.orders.append(tuple(both))
    return m


def _scored(rows: DataFrame, model: Model, text_col: str, each: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``each`` over the batches of ``rows`` with the model, or with what the texts of a block need of the model's table."""
    if model.table is None:
        sent = rows.sparkSession.sparkContext.broadcast(model)
        return rows.mapInArrow(lambda batches: (each(sent.value, batch) for batch in batches), schema)
    names, at = rows.columns, rows.columns.index(text_col)
    rest = _bare(model)
    held = BLOCK_CELLS // (len(rest.langs) + 4)
    blocks = (rows.agg(F.sum(F.length(text_col))).first()[0] or 0) // max(1, held) + 1
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*hashed), F.lit(blocks)))

    def needed(key: tuple, texts: pa.Table) -> pa.Table:
        parts = _needed(texts["__text"].to_pylist())
        n = [len(k) for _, k in parts]
        return pa.table({"__block": np.full(sum(n), key[0].as_py(), np.int64), "part": np.repeat(np.array([p for p, _ in parts], np.int32), n), "key": np.concatenate([k for _, k in parts])})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = _part_of(rest, right)
        return pa.Table.from_batches([each(m, batch) for batch in left.select(names).combine_chunks().to_batches(max_chunksize=_runtime.BATCH_ROWS)])

    keys = dealt.select("__block", F.col(text_col).alias("__text")).groupBy("__block").applyInArrow(needed, "__block long, part int, key long")
    found = keys.join(model.table, ["part", "key"])
    return dealt.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(run, schema)


def _model(counts: DataFrame) -> Model:
    langs = sorted(x[0] for x in counts.select("lang").distinct().collect())
    if counts.count() * max(8, len(langs) + 4) <= 8 * GRAMS:
        # numbers only, and one language at a time: the driver holds little besides the models
        table = counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int").alias("j"), "half", "gram", "n").toPandas()
        of, half, gram, n = (table[c].to_numpy() for c in ("j", "half", "gram", "n"))
        del table

        def held(wanted: np.ndarray) -> Model:
            return Model({x: _merged([gram[at]], [n[at]]) for j, x in enumerate(langs) for at in [np.flatnonzero(wanted & (of == j))]})

        model = held(np.ones(len(of), bool))
        model.halves = [held(half != k) for k in (0, 1)]
        return model
    model, *model.halves = (Model({}) for _ in range(3))
    tables = []
    for k, (m, part) in enumerate(((model, counts), *((model.halves[h], counts.where(F.col("half") != h)) for h in (0, 1)))):
        table = _table_of(part.groupBy("lang", "gram").agg(F.sum("n").alias("n")), langs)
        m.langs, m.limits = langs, np.full((len(langs), CLASSES), np.inf)
        m.floor = 1 / (table.where("part = 0").count() + 1)
        tables.append(table.withColumn("of", F.lit(k)))
    model.table = tables[0].union(tables[1]).union(tables[2])
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages of ``docs``, from all n-grams of all its rows with text and language.

    Up to ``GRAMS`` n-grams, those of each half counted apart, are collected; more are turned into a table of the same models.
    """
    rows = _runtime.in_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = _runtime.cut(rows.mapInArrow(_counts, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")))
    model = _model(counts)
    seen = _scored(rows, model, "text", _own, "lang string, class int, bin long").groupBy("lang", "class", "bin").count().toPandas()
    for j, lang in enumerate(model.langs):
        of = seen[seen["lang"] == lang]
        model.limits[j] = _limits(of["class"].to_numpy(), of["bin"].to_numpy(), of["count"].to_numpy())
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits, accepted) for each row, from its whole text.

    ``bits``: cross-entropy per character in the language; ``score``: its share of the likelihood of at most 30 characters;
    ``accepted``: whether models without the text give it bits within the language's limit for its length. Null texts, texts without a letter and, with an
    untrained model, all texts are 'und' with score 0 and not accepted. Ties go to the first language by name. Null and
    repeated ids each give their row; other columns are ignored; an empty table gives an empty result.
    """
    rows = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scored(rows, model, "text", lambda m, batch: _predictions(m, batch.column(0), batch.column(1).to_pylist()), "doc_id long, lang_pred string, score double, bits double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, ``lang`` set to the language found; all other columns stay."""

    def run(m: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _predictions(m, pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col).to_pylist())
        at = batch.schema.get_field_index(lang_col)
        out = batch.set_column(at, batch.schema.field(at), found["lang_pred"].cast(batch.schema.field(at).type))
        return out.filter(found["accepted"])

    return _scored(_runtime.in_batches(docs), model, text_col, run, docs.schema)

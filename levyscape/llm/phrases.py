"""Phrase collocations from count streams in prefix and suffix order.

Counting goes level by level over whole texts. A task names the phrases of m words whose
two parts of m - 1 words may be frequent (a bitmap of fixed size tells which certainly are
not), counts them slice by slice, and Spark adds up. What reaches the minimum by name goes
into the next level's bitmap; names only hold rows back. A last pass counts the remaining
phrases by their words, so every count is exact. No phrase and no word is a group of rows:
counts are combined before each shuffle.

The counts are one stream per order. In prefix order (by the words from the left) the
phrases cut after k words run in lockstep with the counts of their first parts, and each
phrase with its right extensions; in suffix order (by the words from the right) with the
counts of what remains after the cut, and with the left extensions. Both are sort-merge
joins of sorted streams, no lookup table is held.

A part of a phrase is at least as frequent as the phrase, so all counts that a candidate
needs are in the streams; and if any longer candidate around it is as frequent, so is one
that is longer by a single word.

Defined cases: a null text is empty; a null language is `und`; repeated rows count each;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import in_sieve, lower_case, mix, name_words, sieve, slices, stage, utf8_column, window_names, word_spans

LONGEST, LEAST, BEST = 5, 100, 2000
# bytes of text whose phrases a task holds at a time
SLICE = 2 << 20
# phrases of one length that a task counts before it hands them on
HELD = 1 << 20

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDS = ~BREAKS
WORDS[[0x20, 0x09]] = False


class Words:
    """The words of some texts laid end to end: bytes, places, pieces and names (with the language)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = lower_case()[data]
        self.first, self.end, at = word_spans(self.data, offsets, WORDS)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(BREAKS[self.data])))
        self.piece = cuts[self.first] + self.row
        self.names = mix(name_words(self.data, self.first, self.end), langs[self.row])

    def windows(self, width: int, parts=None) -> tuple[np.ndarray, np.ndarray]:
        """First words and names of the phrases of `width` words; parts: bitmap of what may be frequent of one word less."""
        n = max(0, len(self.names) - width + 1)
        inside = self.piece[:n] == self.piece[width - 1 :]
        if width > 1:
            short = in_sieve(parts, window_names(self.names, width - 1))
            inside &= short[:n] & short[1 : n + 1]
        at = np.flatnonzero(inside)
        return at, window_names(self.names, width)[at]

    def spelled(self, at: np.ndarray, width: int, code: np.ndarray, langs: list[str]) -> tuple[list[str], list[str]]:
        """Languages and words of the phrases that start at these words."""
        words = [b" ".join(self.data[self.first[i] : self.end[i]].tobytes() for i in range(a, a + width)).decode() for a in at.tolist()]
        return [langs[c] for c in code[self.row[at]].tolist()], words


def _texts(batch):
    """Words of a batch (text, lang), slice by slice, and the languages of its rows."""
    data, offsets = utf8_column(batch.column(0))
    langs = batch.column(1).dictionary_encode()
    named = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in slices(offsets, SLICE):
        yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], named[code[i:j]]), code[i:j], langs.dictionary


def _named(width: int, parts):
    def run(batches):
        for batch in batches:
            for words, code, langs in _texts(batch):
                names, n = np.unique(words.windows(width, parts and parts.value)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])

    return run


class Tally:
    """Counts of the phrases of one length that a task has met, each spelled once."""

    def __init__(self):
        self.names = self.second = np.zeros(0, np.uint64)
        self.place = self.n = np.zeros(0, np.int64)
        self.langs, self.phrases = [], []

    def add(self, names, second, n, spell) -> None:
        """names in order; spell: languages and words of some of them, by number."""
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = (self.names[at[known]] == names[known]) & (self.second[at[known]] == second[known])
        self.n[self.place[at[known]]] += n[known]
        new = np.flatnonzero(~known)
        langs, phrases = spell(new)
        place = np.arange(len(self.n), len(self.n) + len(new))
        self.langs += langs
        self.phrases += phrases
        self.n = np.concatenate((self.n, n[new]))
        every = np.concatenate((self.names, names[new]))
        order = np.argsort(every, kind="stable")
        self.names, self.second, self.place = every[order], np.concatenate((self.second, second[new]))[order], np.concatenate((self.place, place))[order]

    def rows(self, size: int) -> pa.RecordBatch:
        return _rows(self.langs, size, self.phrases, self.n)


def _rows(langs, size: int, phrases, n) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array([size] * len(langs), pa.int32()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])


def _spelled(sieves):
    def run(batches):
        held, totals = [Tally() for _ in sieves], Counter()
        for batch in batches:
            for words, code, langs in _texts(batch):
                langs = langs.to_pylist()
                totals.update(dict(zip(langs, np.bincount(code[words.row], minlength=len(langs)).tolist())))
                other = mix(name_words(words.data ^ np.uint8(0x5A), words.first, words.end), words.names)
                for width in range(1, len(sieves) + 1):
                    at, names = words.windows(width, sieves[width - 2].value if width > 1 else None)
                    wanted = in_sieve(sieves[width - 1].value, names)
                    at, names = at[wanted], names[wanted]
                    # phrases with equal names have equal words, or else the second name tells them apart
                    second = window_names(other, width)[at]
                    order = np.lexsort((second, names))
                    names, second, at = names[order], second[order], at[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (names[1:] != names[:-1]) | (second[1:] != second[:-1])
                    head = np.flatnonzero(new)
                    n = np.diff(np.concatenate((head, [len(at)])))
                    tally = held[width - 1]
                    tally.add(names[head], second[head], n, lambda new: words.spelled(at[head[new]], width, code, langs))
                    if len(tally.n) > HELD:
                        yield tally.rows(width)
                        held[width - 1] = Tally()
        for width, tally in enumerate(held, 1):
            yield tally.rows(width)
        yield _rows(list(totals), 0, [""] * len(totals), list(totals.values()))

    return run


def task_counts(texts: DataFrame, sieves) -> DataFrame:
    """Counts of the phrases in the bitmaps by task, on twice as many tasks as there are cores at most.

    A frequent phrase is met in nearly every task: with a task for each split, both tasks and
    phrases would grow with the texts, and the rows with their product.
    """
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(tasks).mapInArrow(_spelled(sieves), "lang string, size int, phrase string, n long")


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Counts of the frequent phrases of 1 to `longest` words (lang, size, phrase, f); of all words at size 0, phrase empty."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sieves = []
    for width in range(1, longest + 1):
        named = texts.mapInArrow(_named(width, sieves[-1] if sieves else None), "name long, n long")
        frequent = named.groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        sieves.append(spark.sparkContext.broadcast(sieve(frequent, F.col("name"))))
    return task_counts(texts, sieves).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))


def scored(found: DataFrame) -> DataFrame:
    """Candidates not inside an equally frequent longer one, with their weakest cut: lang, phrase, a, l, r, n, score."""
    total = found.filter("size = 0").select("lang", F.col("f").alias("words"))
    found = found.filter("size > 0")
    stream = found.select("lang", "size", F.split("phrase", " ").alias("w"), "phrase", "f")
    several = stream.filter("size > 1")
    # right extensions in prefix order, left extensions in suffix order: the largest count of each
    around = F.explode(F.array(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"))).alias("part")
    longer = several.filter("size > 2").select("lang", "f", around).groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    alone = several.join(longer.hint("merge"), ["lang", "phrase"], "left").filter("longer is null or longer < f").select("lang", "phrase", "w", "size", F.col("f").alias("a"))
    cut = alone.select("lang", "phrase", "size", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("rest"))
    by_prefix = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    by_suffix = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(by_prefix.hint("merge"), ["lang", "first"]).join(by_suffix.hint("merge"), ["lang", "rest"]).join(total, "lang")
    # 1000 * a * n and l * r within 38 digits
    over = F.lit(1000).cast("decimal(4,0)") * (F.col("a").cast("decimal(16,0)") * F.col("words").cast("decimal(16,0)"))
    cut = cut.withColumn("over", over).withColumn("under", F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)"))
    cut = cut.withColumn("score", F.expr("over div under"))
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("cut"))
    return weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", F.col("cut.words").alias("n"), "cut.score")


def collocations(docs: DataFrame, best: int = BEST, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    rows = scored(stage(counts(docs, longest, least), "counts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0
), grams AS (
  SELECT lang, m, w[i : i + m - 1] AS p FROM places, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, m, p, count(*) AS f FROM grams GROUP BY lang, m, p HAVING count(*) >= 100
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, p[1 : m - 1] AS part, f FROM f WHERE m > 2 UNION ALL SELECT lang, p[2 : m] AS part, f FROM f WHERE m > 2
  ) GROUP BY lang, part
), kept AS (
  SELECT f.* FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.p = longer.part WHERE m > 1 AND (longer.f IS NULL OR longer.f < f.f)
), cuts AS (
  SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM kept
), scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k]
  JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : c.m]
  JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
  array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM weakest
QUALIFY rank <= 2000
"""

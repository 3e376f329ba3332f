"""Spelling variants by a bit-sliced position index.

Words are counted over all texts. Words that differ by one inserted, deleted
or replaced code point are found in blocks of the vocabulary: per (position,
letter) a bitset says which words of the block have the letter there. A word is
compared with the whole block at once, letter by letter: one recurrence keeps the
words without an error so far, others those with one replaced, one additional
or one missing code point, read at the same, the next or the last position.

One edit leaves the first or the second half of a word as it is. So blocks hold
words that share their first half or their second half, and no word meets the whole vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_chunks

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words that count, by length in code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent a form has to be.
RATIO = 5
#: A run whose hash this number divides loses a code point (the typing errors of the registered query).
DAMAGE = 199
#: Words that one bit-sliced index holds; larger groups of words are dealt over pairs of blocks.
BLOCK = 4_096
#: Distinct words that a task counts before it hands them on.
WORDS_AT_ONCE = 200_000


def damaged(run: str, prefix: int, every: int) -> str:
    """``run`` without one code point if ``every`` divides its hash; ``prefix`` is the crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", damage: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of the lower-cased runs of letters of at least ``least_length`` code points in all texts.

    Tasks count their words before anything is shuffled, so a frequent word is a row per task.
    """
    small_batches(docs.sparkSession)
    pattern = regex.compile(LETTERS.replace("+", f"{{{max(1, least_length)},}}"))  # shorter runs cannot become long enough
    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch, texts in text_chunks(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts):
                runs = pattern.findall(raw.lower().decode("utf-8", "replace"))  # bytes: only A-Z are lowered
                if damage is None:
                    found.update(runs)
                else:
                    before = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in Counter(runs).items():
                        found[damaged(word, before, damage)] += n
                if len(found) > WORDS_AT_ONCE:
                    yield hand_on()
        yield hand_on()

    counted = picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.length("word") >= least_length)


def half(m: int) -> int:
    """Code points that one of both ends keeps: an edit leaves at least m - 1 of m in place, or all m beside an additional one."""
    return m // 2


class BitSlices:
    """The bit-sliced position index of a block of words.

    Bitsets are whole numbers; bit i stands for word i. Words are given most
    frequent first, so the lowest bit of a set is its most frequent word.
    """

    def __init__(self, words: list[str]) -> None:
        self.at: dict[tuple[int, str], int] = {}
        self.sized: dict[int, int] = {}
        at, sized = self.at, self.sized
        for i, word in enumerate(words):
            bit = 1 << i
            sized[len(word)] = sized.get(len(word), 0) | bit
            for place in enumerate(word):
                at[place] = at.get(place, 0) | bit

    def near(self, word: str, m: int, side: int) -> int:
        """Words of the block that differ from ``word`` by one edit and belong to the group (m, side).

        Pairs of a class are its words of m code points among each other, and with those of m + 1. A pair that
        agrees in both halves belongs to the first side alone.
        """
        have, size, cut = self.at.get, len(word), half(m)
        none = (1 << max(map(int.bit_length, self.sized.values()), default=0)) - 1  # no error so far: all words
        first, replaced, added, missing = none, 0, 0, 0
        for i, c in enumerate(word):
            same = have((i, c), 0)
            replaced = replaced & same | none & ~same
            missing = missing & have((i - 1, c), 0) | none  # this or an earlier one is not in the other word
            added = (added | none) & have((i + 1, c), 0)  # the other word has had one more
            none &= same
            if i + 1 == cut:
                first = none
        out = 0
        if size == m:
            out = replaced & self.sized.get(m, 0) | (added | none) & self.sized.get(m + 1, 0)
        elif size == m + 1:
            out = missing & self.sized.get(m, 0)
        return out & ~first if side else out


def _groups(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """(word, n, kind, side, part): class m holds words of m and m + 1 code points, by either half; a word is in two classes."""
    size = F.length("word")
    group = lambda m, side, part: F.struct(m.alias("kind"), F.lit(side).alias("side"), part.alias("part"))
    found = []
    for m in (size, size - 1):
        kept = F.floor(m / 2).cast("int")
        found += [group(m, 0, F.substr("word", F.lit(1), kept)), group(m, 1, F.substr("word", size - kept + 1))]
    unfolded = vocabulary.select("word", "n", F.explode(F.array(*found)).alias("g"))
    return unfolded.select("word", "n", "g.kind", "g.side", "g.part").filter(F.col("kind") >= least_length)


KEY = ["kind", "side", "part"]


def _cells(vocabulary: DataFrame, least_length: int, block: int) -> DataFrame:
    """(kind, side, part, low, high, own, word, n): blocks of groups, every pair of blocks of a group in a cell of its own.

    Words alone in their group go. A group of k blocks sends each word to k cells; no cell holds much more than two blocks.
    """
    groups = _groups(vocabulary, least_length)
    sizes = groups.groupBy(*KEY).agg(F.count("*").alias("words")).filter("words > 1")
    blocks = F.ceil(F.col("words") / block).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = groups.join(sizes.select(*KEY, blocks.alias("blocks")), KEY).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select(*KEY, "own", "word", "n", other).select(
        *KEY, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n"
    )


def _near_in_cell(key: tuple, rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, the most frequent of them, its n) of one cell; ``rows`` are (own block, word, n), most frequent first."""
    m, side, _, low, high = key
    blocks: dict[int, list[tuple[str, int]]] = {}
    for own, word, n in rows:
        blocks.setdefault(own, []).append((word, n))
    for held, asking in {(low, high), (high, low)}:
        if held in blocks and asking in blocks:
            index = BitSlices([w for w, _ in blocks[held]])
            for word, _ in blocks[asking]:
                found = index.near(word, m, side)
                if found:
                    form, n = blocks[held][(found & -found).bit_length() - 1]
                    yield word, found.bit_count(), form, n


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of all words of ``vocabulary`` (word, n) that have a near word; the form is the most frequent one.

    Equally frequent ones go by code points. Pairs are counted where they are found and never written out.
    """
    cell = [*KEY, "low", "high"]
    dealt = _cells(vocabulary, least_length, block).repartition(*cell).sortWithinPartitions(*cell, F.desc("n"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def closed() -> pa.RecordBatch:
            found = list(zip(*_near_in_cell(key, rows))) if len(rows) > 1 else []
            columns = found or ([], [], [], [])
            kinds = pa.string(), pa.int64(), pa.string(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "form", "form_n"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:5] != key:
                    if len(rows) > 1:
                        yield closed()
                    key, rows = row[:5], []
                rows.append(row[5:])
        if len(rows) > 1:
            yield closed()

    found = dealt.select(*cell, "own", "word", "n").mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form", "form_n"))
    return (
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", "best.form", "best.form_n")
    )


def with_roots(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, form, n, …) with ``root``: forms followed to the last; the word itself if it has none.

    A form is at least ``ratio`` times as frequent as its word, which bounds the steps. They
    are doubled: after k rounds a root is 2^k forms away. A word has few near words, so no root gathers many words.
    """
    steps = stored(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), "n", F.col("form_n").alias("top")), "forms")
    ends = steps.agg(F.max("top"), F.min("n")).first()
    most = math.log(ends[0] / ends[1], ratio) if ends[0] else 0
    for n in range(math.ceil(math.log2(max(1, most + 1e-9)))):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{n}")
    return words.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    damage: int | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are runs of letters with A-Z lowered that have at least ``least_length`` code points and occur ``least_count``
    times over all texts. Near words differ by one code point inserted, deleted or replaced. A word's ``form`` is its most frequent near word
    (of equally frequent ones the first by code points) if that occurs ``ratio`` times as often or more, else NULL;
    ``root`` follows forms to the last. ``n_near`` counts all near words. With ``damage``, a run loses one code
    point where that number divides the crc32 of ``<id>:<run>``, as a typing error would take it. NULL and empty texts have no
    words, a NULL id counts as an empty one; repeated rows count as often as they are there; very long texts and words are read whole. An empty table
    gives an empty table. Other columns are not read.
    """
    if ratio < 2 or least_length < 1 or least_count < 1:
        raise ValueError("ratio must be at least 2, least_length and least_count at least 1")
    counted = word_counts(docs, text, id_col, damage, least_length)
    vocabulary = stored(counted.filter(F.col("n") >= least_count), "words")
    joined = vocabulary.join(near_words(vocabulary, least_length, block), "word", "left")
    follows = F.col("form_n") >= ratio * F.col("n")
    words = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n"),
        ),
        "near-words",
    )
    return with_roots(words, ratio).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of ``documents``, with the contract's typing errors."""
    return spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


#: crc32 is worked out byte by byte from its table; near words are those with an equal rest after a deletion.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), run AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS marked, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY run, marked
), bytes AS (
  SELECT run, n, list_transform(range(0, octet_length(encode(marked))), lambda i: ('0x' || substr(hex(encode(marked)), 2 * i + 1, 2))::BIGINT) AS b FROM run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), chosen AS (
  SELECT near.word, min(other) AS form, any_value(top) AS form_n FROM near JOIN best ON near.word = best.word AND other_n = top
  GROUP BY near.word, n HAVING any_value(top) >= {RATIO} * near.n
), follow AS (
  SELECT word, form AS last FROM chosen UNION ALL SELECT follow.word, chosen.form FROM follow JOIN chosen ON follow.last = chosen.word
), root AS (
  SELECT word, last FROM follow WHERE last NOT IN (SELECT word FROM chosen)
)
SELECT word, form, coalesce(last, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM vocabulary LEFT JOIN best USING (word) LEFT JOIN chosen USING (word) LEFT JOIN root USING (word)"""
